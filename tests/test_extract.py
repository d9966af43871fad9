"""Extraction from forges that answer from memory, with its state and identity files."""

import json
import stat

import pytest
from pyspark.sql import functions as F

from forgelens import config
from forgelens.functions import columns as C
from forgelens.operators import identity
from forgelens.sources import files, rest
from forgelens.sources.extract import Extraction
from forgelens.sources.forge import GITHUB_COMMIT, github_commits
from forgelens.sources.warehouse import Warehouse, open_warehouse
from forgelens.streaming.ingest import taken

HUB = config.Config(repos=("team/a",), base_url="https://hub.invalid", key="ab" * 32, aliases={"dev3@team.example": "dev1@team.example"})


@pytest.fixture
def store(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path / "w"))
    w.create_tables()
    return w


def counts(store):
    return {t: store.count(t) for t in ("commits", "diffs", "merge_requests", "mr_commits")}


def test_github(spark, store, tmp_path):
    progress, people = files.Progress(tmp_path / "state"), files.IdentityFile(tmp_path / "people.json")
    run = lambda **more: Extraction(spark, store, HUB, transport="tests.forge_double:github", tasks=2, seconds=0, **more)
    assert [r["repo"] for r in run().listed_repos("team").collect()] == ["team/a"]
    assert run().run(progress, people) == counts(store) == {"commits": 3, "diffs": 3, "merge_requests": 1, "mr_commits": 2}
    rows = {r["commit_sha"]: r for r in store.table("commits").collect()}
    assert set(rows) == {"c1", "c2", "c4"} and (rows["c2"]["branch_name"], rows["c4"]["branch_name"]) == ("main", "fix")
    assert rows["c1"]["title"] == "Change c1" and rows["c1"]["author_email"] == rows["c4"]["author_email"] != rows["c2"]["author_email"]
    assert all(len(r["author_name"]) == 12 for r in rows.values()) and "Dev 2" in {p["name"] for p in people.load().values()}
    assert run().run(progress, people)["commits"] == 0 and counts(store)["mr_commits"] == 2 and not progress.exists("team/a")


def test_github_goes_on_after_a_failure(spark, store, tmp_path):
    progress = files.Progress(tmp_path / "state")
    progress.save("team/a", phase="requests")
    added = Extraction(spark, store, HUB, transport="tests.forge_double:github", tasks=2, seconds=0).run(progress)
    assert added == {"commits": 0, "diffs": 0, "merge_requests": 1, "mr_commits": 2}


def test_gitlab(spark, store, tmp_path):
    lab = config.Config(provider="gitlab", repos=("team/b",), base_url="https://lab.invalid", anonymize=False)
    added = Extraction(spark, store, lab, since="2026-01-01", transport="tests.forge_double:gitlab", tasks=2, seconds=0).run(files.Progress(tmp_path / "state"))
    assert added == {"commits": 1, "diffs": 1, "merge_requests": 1, "mr_commits": 1}  # one commit has no diff, one is a bot's; one request is old
    row = store.table("commits").first()
    assert (row["commit_sha"], row["project_id"], row["project_path"], row["author_name"], row["parent_ids"]) == ("l1", "7", "team/b", "Dev", "p,q")
    assert store.table("diffs").first()["additions"] == 1 and store.table("mr_commits").first()["project_id"] == "7"


def test_data_source(spark):
    spark.dataSource.register(rest.ForgeSource)
    options = {"repos": "team/a", "base_url": "https://hub.invalid", "transport": "tests.forge_double:github", "path": "/repos/{repo}/branches"}
    rows = spark.read.format("forge").options(**options).load().collect()
    assert [(r["repo"], r["pos"], json.loads(r["body"])["name"]) for r in rows] == [("team/a", 0, "main"), ("team/a", 1, "fix")]


def test_spacing_and_quota():
    clock, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        clock[0] += s

    ask = rest.Spaced(lambda u, h: (200, {"ratelimit-remaining": "3", "ratelimit-reset": "9"}, "[]"), 0.5, sleep, lambda: clock[0])
    ask("u", {})
    assert rest.fetch("u", {}, ask, sleep, lambda: clock[0])[1] == "[]" and slept == [0.5, 8.5]


def test_identity_file(tmp_path):
    f = files.IdentityFile(tmp_path / "d" / "people.json")
    assert f.load() == {}
    f.add({"h1": ("Ann", "a@x.example")})
    f.add({"h2": ("Bo", "b@x.example"), "h1": ("Ann L", "a@x.example")})
    assert f.load()["h1"]["name"] == "Ann L" and stat.S_IMODE(f.path.stat().st_mode) == 0o600
    f.merged({"h2": "h1", "none": "h1"}, {"h1": ("Ann", "a@x.example")})
    assert f.load()["h2"] == {"name": "Bo", "email": "b@x.example", "merged_into": "h1"} and "merged_into" not in f.load()["h1"]
    f.path.write_text("{broken")
    assert f.load() == {}


def test_keys(spark):
    assert len(files.key_of(files.new_key())) == 32 and files.new_key() != files.new_key()
    row = spark.createDataFrame([("Ann",)], "n string")
    a, b = row.select(C.pseudonym(F.col("n"), files.key_of("00" * 32)), C.pseudonym(F.col("n"), files.key_of("01" * 32))).first()
    assert a != b and len(a) == 12
    with pytest.raises(ValueError):
        files.key_of("no hex")


def test_progress(tmp_path):
    p = files.Progress(tmp_path)
    assert p.load("o/r") is None and not p.exists("o/r")
    p.save("o/r", phase="commits", last_page=3)
    assert p.exists("o/r") and {"phase": "commits", "last_page": 3}.items() <= p.load("o/r").items() and "timestamp" in p.load("o/r")
    (tmp_path / "o_r.json").write_text("{")
    assert p.load("o/r") is None
    p.clear("o/r")
    p.clear("o/r")
    assert not p.exists("o/r")


def test_settings_are_updated(spark, tmp_path):
    path = tmp_path / ".env"
    path.write_text("# REPOS=no\nREPOS=a/b\nREADONLY=1\nWAREHOUSE=w\n")
    found = config.add_merges(str(path), "Main@X.example", ["Alias@x.example", "main@x.example", ""])
    assert found.aliases == {"alias@x.example": "main@x.example"} == config.load(str(path)).aliases
    config.update(str(path), "repos", "c/d")
    assert config.load(str(path)).repos == ("c/d",) and path.read_text().startswith("# REPOS=no\nREPOS=c/d\n")
    assert open_warehouse(spark, config.load(str(path))).readonly
    with pytest.raises(ValueError, match="no warehouse"):
        open_warehouse(spark, config.Config(warehouse=""))


def test_merges_reach_the_file(spark, store, tmp_path):
    f = files.IdentityFile(tmp_path / "people.json")
    f.add({"old": ("Ann", "ann@a.example"), "new": ("Ann Lee", "ann@b.example")})
    store.insert("commits", [{"commit_sha": "s", "author_email": "old"}, {"commit_sha": "t", "author_email": "new"}])
    merges = spark.createDataFrame([("old", "new"), ("old", "newer")], "old string, new string")
    assert identity.apply_merges(store, merges, f) == 1
    assert {r[0] for r in store.table("commits").select("author_email").collect()} == {"new"} and f.load()["old"]["merged_into"] == "new"


class Grown:
    """A growing forge, its warehouse and what was asked of it."""

    def __init__(self, spark, folder):
        self.spark, self.file, self.progress = spark, folder / "forge.json", files.Progress(folder / "state")
        self.store = Warehouse(spark, str(folder / "w"))
        self.store.create_tables()
        self.state = {"commits": {"t/a": [], "t/b": []}, "pulls": {}, "failing": []}
        self.config = config.Config(repos=("t/a", "t/b"), base_url=f"https://grow.invalid{self.file}//api", anonymize=False)

    def grow(self, repo, *days):
        self.state["commits"][repo] += [{"sha": f"{repo[-1]}{day.replace('-', '')}", "date": f"{day}T10:00:00Z", "who": f"dev{day[-1]}"} for day in days]

    def run(self, **more):
        """(rows added, paths asked)"""
        self.file.write_text(json.dumps(self.state))
        asked = self.file.with_name("forge.json.asked")
        asked.write_text("")
        added = Extraction(self.spark, self.store, self.config, transport="tests.forge_double:growing", tasks=2, seconds=0, tries=1, **more).run(self.progress)
        return added, asked.read_text().split()

    def shas(self):
        found = [r[0] for r in self.store.table("commits").select("commit_sha").collect()]
        assert len(found) == len(set(found))
        return set(found)


def test_runs_ask_for_what_is_newer(spark, tmp_path):
    forge = Grown(spark, tmp_path)
    forge.grow("t/a", "2026-03-01", "2026-03-05")
    forge.grow("t/b", "2026-02-01")
    forge.state["pulls"] = {"t/a": [(3, "2026-03-06T00:00:00Z"), (2, "2026-03-02T00:00:00Z"), (1, "2026-01-02T00:00:00Z")]}
    added, asked = forge.run()
    assert added == {"commits": 3, "diffs": 3, "merge_requests": 3, "mr_commits": 3} and not any("since=" in p for p in asked)
    marks = {r["repo"]: str(r["since"]) for r in forge.store.table("watermarks").collect()}
    assert marks == {"t/a": "2026-03-05 10:00:00", "t/b": "2026-02-01 10:00:00"} and not forge.store.exists(f"{forge.store.root}/_landed/x")
    forge.grow("t/a", "2026-03-08")
    added, asked = forge.run()
    assert added["commits"] == 1 and forge.shas() == {"a20260301", "a20260305", "a20260308", "b20260201"}
    assert {p for p in asked if "since=" in p} == {"/repos/t/a/commits?sha=main&since=2026-03-04T10:00:00Z", "/repos/t/b/commits?sha=main&since=2026-01-31T10:00:00Z"}
    assert [p for p in asked if "/commits/" in p and "pulls" not in p] == ["/repos/t/a/commits/a20260308"]  # one detail only
    full, asked = forge.run(full=True)
    assert full["commits"] == 0 and not any("since=" in p for p in asked) and len(forge.shas()) == 4


def test_a_late_commit_within_the_overlap_is_found(spark, tmp_path):
    forge = Grown(spark, tmp_path)
    forge.grow("t/a", "2026-03-05")
    forge.run()
    forge.state["commits"]["t/a"].append({"sha": "late", "date": "2026-03-04T12:00:00Z", "who": "dev"})
    assert forge.run()[0]["commits"] == 1 and "late" in forge.shas()


def test_one_repository_s_failure_ends_nothing_else(spark, tmp_path):
    forge = Grown(spark, tmp_path)
    forge.grow("t/a", "2026-03-01", "2026-03-02", "2026-03-03")
    forge.grow("t/b", "2026-03-01")
    forge.state["failing"] = ["/repos/t/a/commits/a20260302"]
    added, _ = forge.run()
    assert forge.shas() == {"a20260301", "a20260303", "b20260301"} and added["commits"] == 3
    assert forge.progress.exists("t/a") and not forge.progress.exists("t/b") and len(forge.progress.open_runs()) == 1
    dead = forge.store.table("dead_letters").collect()
    assert [(r["repo"], r["what"], r["path"], r["attempts"], r["given_up"]) for r in dead] == [("t/a", "detail", "/repos/t/a/commits/a20260302", 1, False)] and "RuntimeError" in dead[0]["error"]
    assert {r["repo"] for r in forge.store.table("watermarks").collect()} == {"t/b"}
    forge.state["failing"] = []
    added, asked = forge.run()
    mine = [p for p in asked if p.startswith("/repos/t/a")]
    assert added["commits"] == 1 and mine == ["/repos/t/a/commits/a20260302"] and "a20260302" in forge.shas()  # all else of it had been landed
    assert forge.progress.open_runs() == () and {r["repo"] for r in forge.store.table("watermarks").collect()} == {"t/a", "t/b"}
    assert forge.store.tidy(open_runs=()) == []  # answers of finished runs are gone already


def test_paths_are_given_up_in_the_end(spark, tmp_path):
    forge = Grown(spark, tmp_path)
    forge.grow("t/a", "2026-03-01", "2026-03-02")
    forge.state["failing"] = ["a20260302"]
    assert forge.run(attempts=2)[0]["commits"] == 1 and forge.progress.exists("t/a")
    assert forge.run(attempts=2)[0]["commits"] == 0 and not forge.progress.exists("t/a")
    assert sorted((r["attempts"], r["given_up"]) for r in forge.store.table("dead_letters").collect()) == [(1, False), (2, True)]


def test_pages_end_at_what_is_old():
    pages_ = [[{"updated_at": f"2026-03-{d:02d}T00:00:00Z"} for d in days] for days in ((9, 8), (7, 6), (5, 4))]
    asked = []

    def answer(url, headers):
        n = int(url.rsplit("=", 1)[1])
        asked.append(n)
        return 200, {"link": f'<u?page={n + 1}>; rel="next"' if n < 3 else ""}, json.dumps(pages_[n - 1])

    assert len(list(rest.pages("u", {}, answer, rest.before("2026-03-07")))) == 2 and asked == [1, 2]
    assert rest.before(None) is None and len(list(rest.pages("u", {}, answer))) == 3


def test_people_of_merged_addresses_are_known(spark, store, tmp_path):
    people = files.IdentityFile(tmp_path / "people.json")
    run = Extraction(spark, store, HUB, transport="tests.forge_double:github", tasks=2, seconds=0)
    run.run(files.Progress(tmp_path / "state"), people)
    stored = {r[0] for r in store.table("commits").select("author_email").collect()}
    known = people.load()
    assert stored <= set(known) and {known[h]["email"] for h in stored} == {"dev1@team.example", "dev2@team.example"}


def stream_of(forge, folder, **options):
    """One run of a query over the growing forge, from its checkpoint on; (batches, paths asked)."""
    forge.file.write_text(json.dumps(forge.state))
    asked = forge.file.with_name("forge.json.asked")
    asked.write_text("")
    forge.spark.dataSource.register(rest.ForgeSource)
    options = {"repos": "t/a,t/b", "base_url": forge.config.base_url, "transport": "tests.forge_double:growing"} | options
    stream = forge.spark.readStream.format("forge").options(**options).load()
    whole = lambda rows: github_commits(rows.select("repo", F.from_json("body", GITHUB_COMMIT).alias("c")).select("repo", "c.*"), F.col("repo"))
    query = taken(stream, whole, forge.store, "commits", ("commit_sha",), str(folder / "checkpoint"), within="committed_date")
    query.awaitTermination(60)
    assert query.exception() is None
    return asked.read_text().split()


def test_a_forge_as_a_stream(spark, tmp_path):
    """Two queries over one checkpoint, the forge growing between them: nothing is lost or there twice."""
    forge = Grown(spark, tmp_path)
    forge.grow("t/a", "2026-03-01", "2026-03-05")
    stream_of(forge, tmp_path)
    assert forge.shas() == {"a20260301", "a20260305"}
    forge.grow("t/a", "2026-03-08")
    forge.grow("t/b", "2026-01-01")
    asked = stream_of(forge, tmp_path)
    assert forge.shas() == {"a20260301", "a20260305", "a20260308", "b20260101"}
    assert "/repos/t/a/commits?since=2026-03-05T10:00:00Z&until=2026-03-08T10:00:00Z" in asked and not any("since" in p for p in asked if "t/b" in p)
    asked = stream_of(forge, tmp_path)
    assert len(forge.shas()) == 4 and not any("until" in p for p in asked)  # nothing new: only the newest are looked at
    forge.state["commits"]["t/a"].append({"sha": "late", "date": "2026-03-07T12:00:00+01:00", "who": "dev"})
    forge.grow("t/a", "2026-03-09")
    stream_of(forge, tmp_path, overlap_hours="48")
    assert forge.shas() == {"a20260301", "a20260305", "a20260308", "a20260309", "b20260101", "late"}


def test_offsets_of_the_stream():
    reader = rest.ForgeStreamReader({"repos": "t/a", "base_url": "u", "since": "2026-01-01T00:00:00Z"})
    assert reader.initialOffset() == {"t/a": "2026-01-01T00:00:00Z"}
    spans = reader.partitions({"t/a": "2026-01-01T00:00:00Z", "t/b": "5"}, {"t/a": "2026-02-01T00:00:00Z", "t/b": "5", "t/c": "7", "t/d": ""})
    assert [(s.repo, s.after, s.upto) for s in spans] == [("t/a", "2026-01-01T00:00:00Z", "2026-02-01T00:00:00Z"), ("t/c", "", "7")]
    assert reader._date({"commit": {"committer": {"date": "2026-03-07T12:00:00+02:00"}}}) == "2026-03-07T10:00:00Z" and reader._date({"commit": None}) == ""
