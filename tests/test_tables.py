"""Warehouse, ingest, identity, scoring and validation on small cases."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from forgelens.functions import columns as C
from forgelens.operators import identity, metrics, scoring, validation
from forgelens.operators.closure import components
from forgelens.schemas import SCHEMAS, ddl, schema_of
from forgelens.sources import forge, rest
from forgelens.sources.lease import Lease
from forgelens.sources.warehouse import Warehouse
from forgelens.streaming.ingest import ingest
from forgelens.streaming.scores import score_batch, score_stream

COMMITS = [
    {"commit_sha": "s1", "project_path": "team/tool", "author_name": "p1", "author_email": "m1", "authored_date": dt.datetime(2025, 4, 3, 9), "additions": 70, "deletions": 4},
    {"commit_sha": "s2", "project_path": "team/tool", "author_name": "p2", "author_email": None, "authored_date": dt.datetime(2025, 5, 20, 17), "additions": 8, "deletions": 2, "unknown": 1},
]


@pytest.fixture
def store(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path / "w"))
    w.create_tables()
    w.create_tables()
    w.insert("commits", COMMITS)
    return w


def test_tidy_keeps_the_newest_versions(store):
    for n in (3, 4):
        store.replace("commits", store.table("commits").withColumn("additions", F.lit(n)))
    store.table("diffs").write.parquet(f"{store.root}/diffs/_new-failed")
    assert store.tidy() == ["commits/v000000", "diffs/_new-failed"] and store.tidy(1) == ["commits/v000001"] and store.tidy(1) == []
    assert {r["additions"] for r in store.table("commits").collect()} == {4} and store.count("diffs") == 0
    with pytest.raises(ValueError):
        store.tidy(0)


def test_schemas():
    assert {k: len(v) for k, v in SCHEMAS.items()} == {"commits": 20, "diffs": 11, "merge_requests": 19, "mr_commits": 5, "commit_scores": 5, "file_scores": 6}
    assert all(ddl(t).startswith(f"CREATE TABLE IF NOT EXISTS {t} (") for t in SCHEMAS)
    with pytest.raises(ValueError, match="unknown table"):
        schema_of("people")


def test_store(spark, store):
    assert store.count("commits") == 2 and store.count("diffs") == 0
    assert {r[0] for r in store.existing_shas().collect()} == {"s1", "s2"}
    assert store.query("SELECT commit_sha FROM commits WHERE additions > :least", {"least": 10}).count() == 1
    assert store.table("commits").columns == SCHEMAS["commits"].names
    store.insert("commits", [])
    reader = Warehouse(spark, store.root, readonly=True)
    assert reader.count("commits") == 2
    for change in (reader.create_tables, lambda: reader.insert("commits", COMMITS), lambda: reader.replace("commits", reader.table("commits"))):
        with pytest.raises(RuntimeError, match="read-only"):
            change()


def test_merges_rewrite_the_table(spark, store):
    merges = spark.createDataFrame([("p2", "p1")], "old string, new string")
    assert identity.apply_merges(store, merges) == 1
    assert identity.apply_merges(store, merges) == 0
    assert {r[0] for r in store.table("commits").select("author_name").collect()} == {"p1"} and store.count("commits") == 2


def test_empty_period_and_null_emails(spark, store):
    c = store.table("commits")
    f = metrics.Filters("2025-01-01", "2026-01-01")
    rows = {r["period"]: r for r in metrics.period_comparison(c, None, f, ("2025-04-01", "2025-05-01"), ("2027-01-01", "2028-01-01")).collect()}
    assert rows["comparison"]["commits"] == 0 and rows["comparison"]["total_lines_changed"] is None and rows["% change"]["commits"] == -100.0
    rows = {r["period"]: r for r in metrics.period_comparison(c, None, f, ("2030-01-01", "2031-01-01"), ("2025-01-01", "2026-01-01")).collect()}
    assert rows["baseline"]["commits"] == 0 and rows["% change"]["commits"] is None
    assert metrics.monthly_trends(c, None, f).count() == 2
    assert metrics.monthly_trends(c, None, metrics.Filters("2025-01-01", "2026-01-01", excluded=("nobody",))).count() == 1
    assert metrics.monthly_trends(c, None, metrics.Filters("2025-01-01", "2026-01-01", repos=("team/other",))).count() == 0


def test_velocity_at_exactly_seven_days(spark):
    day = dt.datetime(2026, 1, 1)
    rows = [("1", "r", None, "merged", day, day + dt.timedelta(days=7)), ("2", "r", None, "merged", day, day + dt.timedelta(days=7, seconds=1)), ("3", "r", None, "closed", day, day)]
    m = spark.createDataFrame(rows, "mr_id string, project_name string, author_email string, state string, created_at timestamp_ntz, merged_at timestamp_ntz")
    [r] = metrics.merge_velocity(m, metrics.Filters("2026-01-01", "2026-02-01")).collect()
    assert (r["merged_count"], r["merged_within_7d"], r["merged_within_30d"], r["merge_rate_pct"]) == (2, 1, 2, 66.7)


def test_efficiency_wildcards(spark):
    c = spark.createDataFrame([("s", dt.datetime(2026, 1, 2), 10, "e", "p", "p")], "commit_sha string, authored_date timestamp_ntz, additions int, author_email string, project_path string, project_id string")
    m = spark.createDataFrame([("1", "my_repo", "org/my_repo", "merged")], "mr_iid string, project_name string, project_id string, state string")
    x = spark.createDataFrame([("1", "org/notmyxrepo", "s")], "mr_iid string, project_id string, commit_sha string")
    f = metrics.Filters("2026-01-01", "2026-02-01")
    assert metrics.code_efficiency(c, m, x, f).first()["efficiency_pct"] == 100.0
    assert metrics.code_efficiency(c, m, x, f, strict=True).first()["efficiency_pct"] == 0.0


def test_duplicate_identities(spark):
    rows = [(1, "Ann Lee", "ann@a.example"), (2, "ann lee", "lee@b.example"), (3, "A", "ANN@c.example"), (4, "ann-lee", "x@d.example"), (5, "Admin", "q@a.example"), (6, "admin", "r@a.example"), (7, "Ann Lee", "ANN@A.example")]
    found = {(r["email_a"], r["email_b"]): r["reason"] for r in identity.duplicate_identities(spark.createDataFrame(rows, "ord int, name string, email string")).collect()}
    assert found["ann@a.example", "lee@b.example"] == "exact_name_match" and found["ann@a.example", "ANN@c.example"] == "same_local_part"
    assert found["ann@a.example", "x@d.example"] == "normalized_name_match" and not any("q@a" in a or "q@a" in b for a, b in found)


def test_productivity_of_replies(spark):
    diffs = spark.createDataFrame([("s", "a.py", 10, 5, 1), ("s", "a.py", 20, 0, 2), ("s", "z.md", None, 4, 1), ("t", "e", 0, 0, 1)], "commit_sha string, file_path string, additions int, deletions int, pos int")
    body = {"files": [{"path": "a.py", "score": 0.5, "category": "odd"}, {"path": "z.md", "score": 0.9, "category": "docs"}, {"path": "not there", "score": 1.0}], "overall_category": "feature"}
    replies = spark.createDataFrame([("s", json.dumps(body)), ("t", '{"files": [{"path": "e", "score": 0.5}]}')], "commit_sha string, reply string")
    scored = scoring.scored_files(scoring.reply_files(replies), diffs, order="pos")
    got = {r["commit_sha"]: (r["total_productivity"], r["weighted_score"]) for r in scoring.commit_productivity(scored).collect()}
    assert got == {"s": (10.15, round(10.15 / 24, 4)), "t": (0.5, 0.0)}
    assert {r["file_path"]: r["category"] for r in scoring.file_score_rows(scored).collect()} == {"a.py": "chore", "z.md": "docs", "e": "chore"}
    c = spark.createDataFrame([("s", "T", "M", dt.datetime(2026, 1, 1), "e", "n")], "commit_sha string, title string, message string, committed_date timestamp_ntz, author_email string, author_name string")
    bundles = scoring.commit_bundles(c, diffs.withColumn("diff", F.repeat(F.lit("+x"), 900)))
    assert "- a.py (+10/-5)" in scoring.prompts(bundles).first()["prompt"]
    only_short = lambda p: '{"files": [{"path": "a.py"}]}' if len(p) < 4000 and "- z.md (+0/-4)" in p else '{"no": 1}'
    assert [r["reply"] for r in scoring.scored_by(bundles, only_short, tasks=1, sleep=lambda s: None).collect()] == ['{"files": [{"path": "a.py"}]}']
    assert scoring.unscored_commits(c, got_scores := spark.createDataFrame([("x",)], "commit_sha string"), ("E",)).count() == 0
    assert scoring.unscored_commits(c, got_scores).count() == 1


def test_asking_a_scorer():
    slept, asked = [], []

    def scorer(answers):
        def reply(prompt):
            asked.append(prompt)
            found = answers.pop(0)
            if isinstance(found, Exception):
                raise found
            return found

        return reply

    good = 'Here: ```json\n{"files": []}\n```'
    assert scoring.ask(scorer([scoring.RateLimited(), ValueError(), good]), ["l", "m", "s"], slept.append) == good and (slept, asked) == ([2.0, 0.5], ["l", "m", "s"])
    assert scoring.ask(scorer(["no", '{"other": 1}', "{broken"]), ["l", "m", "s"], slept.append) is None and slept == [2.0, 0.5, 0.5, 0.5]


def test_scores_are_written_once(spark, store):
    store.insert("diffs", [{"commit_sha": "s1", "file_path": "src/a.py", "additions": 70, "deletions": 4, "diff": "+x"}, {"commit_sha": "s2", "file_path": "README.md", "additions": 8, "deletions": 2, "diff": "+y"}])
    assert scoring.score_commits(store, limit=1) == 1 and scoring.score_commits(store) == 1 and scoring.score_commits(store) == 0
    rows = {r["commit_sha"]: r for r in store.table("commit_scores").collect()}
    assert (rows["s1"]["overall_category"], rows["s2"]["overall_category"]) == ("feature", "docs") and rows["s2"]["total_productivity"] == 1.2 and store.count("file_scores") == 2
    store.insert("commits", [{"commit_sha": "s3"}])
    store.insert("diffs", [{"commit_sha": "s3", "file_path": "b.py", "additions": 4, "deletions": 0, "diff": "+z"}])
    reply = json.dumps({"files": [{"path": "b.py", "score": 0.5, "category": "bugfix", "reasoning": "r"}], "overall_category": "bugfix"})
    assert scoring.score_commits(store, lambda p: reply) == 1
    row = store.table("commit_scores").filter("commit_sha = 's3'").first()
    assert (row["total_productivity"], row["weighted_score"], row["overall_category"]) == (2.0, 0.5, "bugfix") and row["scored_at"] is not None


def test_numbers_that_all_projects_share(spark):
    """1000 projects with the same request numbers, names with and without wildcards."""
    n = spark.range(1000).select(F.concat(F.lit("org/p_"), F.col("id").cast("string")).alias("project_id"), F.concat(F.lit("p_"), F.col("id").cast("string")).alias("project_name"), F.explode(F.sequence(F.lit(1), F.lit(5)).cast("array<string>")).alias("mr_iid"))
    links = n.select("project_id", "mr_iid", F.concat_ws("-", "project_id", "mr_iid").alias("commit_sha"))
    merged = n.filter("project_id LIKE '%7'").select("mr_iid", "project_name", F.col("project_id").alias("mr_project"))
    want = {r[0] for r in links.filter("project_id LIKE '%7'").select("commit_sha").collect()}
    assert {r[0] for r in metrics._held(links, merged, True).collect()} == want
    assert want <= {r[0] for r in metrics._held(links, merged, False).collect()}
    ids, names = ["org/a_b", "org/axb", "x", "org/100%", "b"], ["a_b", "b", "_", "0%", "", "org/a_b", "%x%"]
    pairs = metrics._like_pairs(spark.createDataFrame([(i,) for i in ids], "project_id string"), spark.createDataFrame([(i,) for i in names], "project_name string"))
    slow = spark.createDataFrame([(i, k) for i in ids for k in names], "project_id string, project_name string").filter("project_id LIKE concat('%', project_name)")
    assert sorted(map(tuple, pairs.select("project_id", "project_name").collect())) == sorted(map(tuple, slow.collect()))


def test_identity_groups_stay_linear(spark):
    d = spark.range(3000).select(F.col("id").alias("ord"), F.concat(F.lit("Person "), F.col("id").cast("string")).alias("name"), F.concat(F.lit("info@c"), F.col("id").cast("string"), F.lit(".example")).alias("email"))
    rows = identity.identity_groups(d)
    assert rows.count() == 2999 and rows.select("first_email", "reason", "size").distinct().collect() == [("info@c0.example", "same_local_part", 3000)]


@pytest.mark.parametrize(
    ("metric", "a", "b", "want"),
    [("m.avg", None, None, "PASS"), ("m.avg", None, "1", "FAIL"), ("m.avg", "1.0", "1.009", "OK"), ("m.avg", "1.0", "1.1", "FAIL"), ("m.commits", "3", "3.0", "PASS"), ("m.commits", "3", "4", "FAIL"),
     ("author[accounts@x].total_productivity", "1", "1.005", "OK"), ("m.top", "a", "a", "PASS"), ("m.top", "a", "b", "FAIL")],
)
def test_status(spark, metric, a, b, want):
    rows = spark.createDataFrame([(metric, a, b)], "metric string, reference string, result string")
    assert validation.compared(rows).first()["status"] == want


def test_snapshot_round_trip(spark, tmp_path):
    t = spark.createDataFrame([("2026-01", 3), ("2026-02", None)], "month string, commits int")
    validation.save_snapshot({"monthly_trends": t}, ("2026-01-01", "2027-01-01"), "now", str(tmp_path / "s.json"))
    back = validation.load_snapshot(spark, str(tmp_path / "s.json"))["monthly_trends"]
    results = validation.compare_monthly(back, t)
    assert validation.verdict(results) == ("Validation: 2 PASS, 0 OK, 0 FAIL", 0) and validation.validate({}, {}) is None
    assert validation.all_passed(results) and validation.summary(results).first()["n"] == 2
    (tmp_path / "s.csv").write_text("dataset,month,commits\nmonthly_trends,2026-01,3\n")
    assert validation.load_snapshot(spark, str(tmp_path / "s.csv"))["monthly_trends"].first()["commits"] == 3
    with pytest.raises(ValueError, match="snapshot"):
        validation.load_snapshot(spark, "x.txt")


LAB = {"id": "s1", "title": "T", "message": "M", "author_name": "Ann", "author_email": "ann@x.example", "authored_date": "2026-01-15T10:00:00.000+00:00", "committed_date": "2026-01-15T10:00:00Z",
       "parent_ids": ["p", "q"], "stats": {"additions": 1, "deletions": 1, "total": 2}, "diffs": [{"old_path": "o", "new_path": "", "diff": "+a\n-b", "new_file": False}]}


def test_stream_takes_each_commit_once(spark, tmp_path):
    store = Warehouse(spark, str(tmp_path / "w"))
    store.create_tables()
    landed = tmp_path / "landed"
    landed.mkdir()

    def take(within=None):
        ingest(spark, str(landed), forge.GITLAB_COMMIT, lambda b: forge.gitlab_commits(b, "7", "org/repo"), store, "commits", ("commit_sha",), str(tmp_path / "c"), within).awaitTermination()
        return store.count("commits")

    (landed / "1.json").write_text(json.dumps([LAB, LAB | {"id": "s2"}, LAB | {"id": "none", "diffs": []}]))
    assert take() == 2
    (landed / "2.json").write_text(json.dumps([LAB | {"id": "s2"}, LAB | {"id": "s3"}]))
    assert take() == 3 and take() == 3
    (landed / "3.json").write_text(json.dumps([LAB | {"id": "s3"}, LAB | {"id": "s4", "committed_date": "2026-02-01T10:00:00Z"}]))
    assert take("committed_date") == 4
    (landed / "4.json").write_text(json.dumps([LAB | {"id": "s4", "committed_date": "2026-02-01T10:00:00Z"}, LAB | {"id": "none", "diffs": []}]))
    assert take("committed_date") == 4
    row = store.table("commits").filter("commit_sha = 's1'").first()
    assert (row["parent_ids"], row["project_name"], str(row["authored_date"])) == ("p,q", "repo", "2026-01-15 10:00:00")


def test_gitlab_diffs(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([LAB]))
    row = forge.gitlab_diffs(forge.read_json(spark, str(tmp_path / "a.json"), forge.GITLAB_COMMIT)).first()
    assert (row["file_path"], row["additions"], row["deletions"]) == ("o", 1, 1)


def fake(url, headers):
    page = int(url.split("page=")[-1])
    body = [{"n": i} for i in range(100 if page == 1 else 3)]
    return 200, {"link": f'<{url[:-1]}2>; rel="next"'} if page == 1 else {"link": ""}, json.dumps(body)


def test_rest_source(spark):
    spark.dataSource.register(rest.ForgeSource)
    options = {"repos": "a/b, c/d", "base_url": "http://forge.invalid", "transport": f"{__name__}:fake"}
    reader = rest.ForgeReader(options)
    assert [p.repo for p in reader.partitions()] == ["a/b", "c/d"]
    assert sum(len(p) for p in rest.pages("http://forge.invalid/x", {}, fake)) == 103


def test_retries():
    slept, answers = [], [(500, {}, ""), (429, {"retry-after": "7"}, ""), (403, {"x-ratelimit-reset": "50"}, ""), (200, {}, "[]")]
    assert rest.fetch("u", {}, lambda u, h: answers.pop(0), slept.append, lambda: 40.0) == ({}, "[]")
    assert slept == [1, 7.0, 10.0]
    assert rest.fetch("u", {}, lambda u, h: (404, {}, ""), slept.append) is None
    with pytest.raises(RuntimeError, match="after 5 attempts"):
        rest.fetch("u", {}, lambda u, h: (500, {}, ""), lambda s: None)


def test_odd_snapshots_are_compared(spark):
    """Without a known metric, without a measure to rank by, with NaN, and with repeated authors, of whom the last row counts."""
    now = spark.createDataFrame([("2026-01", 3)], "month string, commits long")
    assert validation.compare_monthly(now.select("month", F.lit(1).alias("other")), now).collect() == []
    first = spark.createDataFrame([("2026-01", 3), ("2026-01", 4)], "month string, commits long").coalesce(1)
    assert validation.compare_monthly(now, first).first()["status"] == "PASS"
    authors = spark.createDataFrame([("a@x", 9, 1.0), ("b@x", 7, 2.0), ("a@x", 5, 1.0)], "author_email string, commits long, total_productivity double").coalesce(1)
    found = {r["metric"]: r["status"] for r in validation.compare_authors(spark.createDataFrame([("a@x", "5")], "author string, commits string"), authors).collect()}
    assert found["author[a@x].commits"] == "PASS"
    only = validation.compare_authors(spark.createDataFrame([("b@x", "2.0")], "author_email string, total_productivity string"), authors.drop("total_productivity")).collect()
    assert [(r["metric"], r["status"]) for r in only] == [("author_ranking", "FAIL"), ("author[b@x].total_productivity", "FAIL")]
    assert validation.compare_authors(spark.createDataFrame([("b@x",)], "author_email string"), authors).count() == 0
    odd = spark.createDataFrame([("x.commits", "NaN", "3"), ("x.commits", "NaN", "NaN"), ("x.commits", "Infinity", "3"), ("avg", "NaN", "1.0"), ("x.commits", "1e30", "1e30")], "metric string, reference string, result string")
    assert [r["status"] for r in validation.compared(odd).collect()] == ["FAIL", "PASS", "FAIL", "FAIL", "PASS"]


def slow_scorer(prompt):
    """50 ms a reply, which names the commit."""
    import time

    time.sleep(0.05)
    title = prompt.split("\n")[0]
    return json.dumps({"files": [{"path": "a.py", "score": len(title) % 10 / 10, "category": "feature"}], "overall_category": "feature", "title": title})


def test_calls_in_flight_are_faster_and_in_order(spark):
    import time

    bundles = scoring.commit_bundles(
        spark.createDataFrame([(f"c{i:03d}", f"Title {i}", "m") for i in range(200)], "commit_sha string, title string, message string"),
        spark.createDataFrame([(f"c{i:03d}", "a.py", 1, 0, "+x") for i in range(200)], "commit_sha string, file_path string, additions int, deletions int, diff string"),
    ).cache()
    bundles.count()
    took, replies = {}, {}
    for n in (1, 10):
        start = time.perf_counter()
        replies[n] = [tuple(r) for r in scoring.scored_by(bundles, "tests.test_tables:slow_scorer", tasks=1, in_flight=n).collect()]
        took[n] = time.perf_counter() - start
    assert took[1] > 10 > 4 > took[10] and sorted(replies[1]) == sorted(replies[10]) and len(replies[10]) == 200
    assert list(scoring.in_order(lambda x: x * x, range(100), 7)) == [x * x for x in range(100)]


def test_errors_of_a_call_end_no_other():
    def call(prompt):
        if prompt == "bad":
            raise RuntimeError("no")
        return '{"files": []}'

    found = list(scoring.in_order(lambda p: scoring.ask(call, [p] * 3, lambda s: None), ["a", "bad", "b"], 2))
    assert found == ['{"files": []}', None, '{"files": []}']


def test_a_lease_holds_for_all(tmp_path):
    """Two tasks, one clock: no window has more calls than it may, and one that stops leaves its part."""
    clock, begun = [100.0], []

    def sleep(s):
        clock[0] += s

    both = [Lease(f"file://{tmp_path}/l", 3, 2.0, sleep, lambda: clock[0]) for _ in range(2)]
    for i in range(12):
        both[i % 2 if i < 6 else 0].take()
        begun.append(int(clock[0] // 2))
    assert [begun.count(w) for w in sorted(set(begun))] == [3, 3, 3, 3] and len(list((tmp_path / "l").iterdir())) <= 3
    with pytest.raises(ValueError):
        Lease("x", 0)


def test_scores_by_a_named_scorer(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path / "w"))
    w.create_tables()
    w.insert("commits", [{"commit_sha": f"s{i}", "title": f"T{i}", "message": "m"} for i in range(6)])
    w.insert("diffs", [{"commit_sha": f"s{i}", "file_path": "a.py", "additions": n, "deletions": 0, "diff": "+x"} for i in range(6) for n in (2, 5)])  # a path twice: the larger counts
    assert scoring.score_commits(w, "tests.test_tables:slow_scorer", tasks=2, in_flight=3, calls_a_second=50) == 6
    assert {(r["total_productivity"], r["overall_category"]) for r in w.table("commit_scores").collect()} == {(4.5, "feature")} and w.count("file_scores") == 6
    assert scoring.score_commits(w, "tests.test_tables:slow_scorer", tasks=2) == 0 and w.tidy(open_runs=()) == []


def test_components_are_those_of_brute_force(spark):
    """A long chain, a very large group, and groups at random; nulls link nothing."""
    rng = random.Random(3)
    rows = [(i, f"chain{i}") for i in range(60)] + [(i + 1, f"chain{i}") for i in range(60)] + [(100 + i, "hot") for i in range(400)]
    rows += [(rng.randrange(600, 700), f"g{rng.randrange(70)}") for _ in range(110)] + [(None, "hot"), (5, None), (60, "chain59"), (900, "alone")]
    label = {n: n for n, g in rows if n is not None and g is not None}
    groups = {}
    for n, g in rows:
        if n is not None and g is not None:
            groups.setdefault(g, set()).add(n)
    changed = True
    while changed:
        changed = False
        for members in groups.values():
            least = min(label[n] for n in members)
            for n in members:
                changed |= label[n] != least
                label[n] = least
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(rows, "node long, group string")).collect()}
    assert found == label
    assert components(spark.createDataFrame([], "node long, group string")).collect() == []


def test_sql_functions_are_the_column_functions(spark, tmp_path):
    """Each can be called from Warehouse.query, says what the column function does, and is inlined."""
    w = Warehouse(spark, str(tmp_path / "w"))
    w.create_tables()
    people = [("s1", "dependabot[bot]", "x@y"), ("s2", " Ann.Lee_B ", "a@x.example"), ("s3", "Ann", "29139614+z@users.noreply.github.com"), ("s4", None, None), ("s5", "\u00a0Codecov\t", "q@z"), ("s6", "x", "a\nbot@x")]
    w.insert("commits", [{"commit_sha": s, "author_name": n, "author_email": e, "authored_date": dt.datetime(2026, 3, 4, 5)} for s, n, e in people])
    paths = ["a/dist/x", "README.md", "big.json", "package.json", "x.lock", "İ.MIN.JS", "a.py", "..md", "locales/../q/locales/de.yml"]
    w.insert("diffs", [{"commit_sha": "s1", "file_path": p, "additions": 600, "deletions": 1, "diff": "@@ -1 +1 @@\n--- a\n+++ b\n-old\n+new\n same"} for p in paths])
    got = w.query("SELECT commit_sha, is_bot(author_name, author_email) AS b, normalized_name(author_name) AS n, month_of(authored_date) AS m FROM commits")
    want = w.table("commits").select("commit_sha", C.is_bot(F.col("author_name"), F.col("author_email")).alias("b"), C.normalized_name(F.col("author_name")).alias("n"), C.month_of(F.col("authored_date")).alias("m"))
    assert sorted(got.collect()) == sorted(want.collect()) and "is_bot(" not in got._jdf.queryExecution().optimizedPlan().toString()
    got = w.query("SELECT file_path, auto_score(file_path) AS a, capped_score(file_path, 0.9D, additions + deletions) AS c, valid_category(file_path) AS v FROM diffs")
    path = F.col("file_path")
    want = w.table("diffs").select("file_path", C.auto_score(path).alias("a"), C.capped_score(path, F.lit(0.9), F.col("additions") + F.col("deletions")).alias("c"), C.valid_category(path).alias("v"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    lines = w.query("SELECT l.* FROM diffs, LATERAL diff_lines(diff) l WHERE file_path = :p ORDER BY line", {"p": "a.py"}).collect()
    assert [tuple(r) for r in lines] == [(1, "@", "@@ -1 +1 @@"), (2, " ", "--- a"), (3, " ", "+++ b"), (4, "-", "old"), (5, "+", "new"), (6, " ", " same")]
    assert w.query("SELECT pct_change(0D, 5D) AS a, pct_change(NULL, 5D) AS b, pct_change(8D, 9D) AS c, days_between(TIMESTAMP_NTZ'2026-01-01', TIMESTAMP_NTZ'2026-01-02 12:00:00') AS d").first() == (None, None, 12.5, 1.5)


def test_scores_of_a_stream(spark, tmp_path):
    """Each commit once, also when it comes again or a batch is tried again; state goes with the watermark."""
    w = Warehouse(spark, str(tmp_path / "w"))
    w.create_tables()
    w.insert("diffs", [{"commit_sha": f"s{i}", "file_path": "a.py", "additions": 4, "deletions": 0, "diff": "+x"} for i in range(8)])
    landed = str(tmp_path / "landed")

    def land(day, *names):
        rows = [(n, f"T {n}", dt.datetime(2026, 3, day)) for n in names]
        spark.createDataFrame(rows, "commit_sha string, title string, extracted_at timestamp_ntz").withColumn("message", F.lit("m")).coalesce(1).write.mode("append").parquet(landed)

    def run(**how):
        stream = spark.readStream.schema("commit_sha string, title string, extracted_at timestamp_ntz, message string").parquet(landed)
        q = score_stream(stream, w, str(tmp_path / "c"), delay="2 days", **how)
        q.awaitTermination(60)
        assert q.exception() is None
        return {r[0] for r in w.table("commit_scores").select("commit_sha").collect()}, w.count("commit_scores"), [(p.stateOperators[0].numRowsTotal, p.numInputRows) for p in q.recentProgress if p.stateOperators]

    land(1, "s0", "s1", "s1")
    assert run()[:2] == ({"s0", "s1"}, 2)
    land(2, "s1", "s2")
    assert run(scorer="tests.test_tables:slow_scorer", tasks=2, in_flight=2)[:2] == ({"s0", "s1", "s2"}, 3) and w.count("file_scores") == 3
    land(20, "s3")
    assert run()[1] == 4
    land(21, "s4")
    found, n, state = run()
    assert n == 5 and [total for total, taken in state if taken] == [2]  # s0 to s2 are forgotten
    score_batch(w, w.table("commits"), "scores", 0)  # tried again: it is whole
    assert w.count("commit_scores") == 5
    commits = spark.createDataFrame([("s5", "T", "m")], "commit_sha string, title string, message string")
    score_batch(w, commits, "other", 0)
    w._fs().delete(w._path("_batches", "other-0", "done"), False)  # as if the attempt had ended before it was whole
    score_batch(w, commits, "other", 0)
    assert w.count("commit_scores") == 6 and w.count("file_scores") == 6


def test_groups_of_people_are_numbers_and_their_texts_stay_apart(spark, monkeypatch):
    given = []
    monkeypatch.setattr(identity, "components", lambda members: given.append(members) or components(members))
    rows = spark.createDataFrame([(1, "Ann", "ann@x"), (2, "Ann", "b@x"), (3, "Zed", "ANN@y"), (4, "Cy", "c@x"), (5, "Cy", "c@y")], "ord long, name string, email string")
    found = {r["ord"]: (r["component"], r["size"], r["n_shared"]) for r in identity.identity_components(rows).collect()}
    assert found == {1: (1, 3, 3), 2: (1, 3, 3), 3: (1, 3, 3), 4: (4, 2, 3), 5: (4, 2, 3)}
    assert "string" not in given[0].schema.simpleString()
