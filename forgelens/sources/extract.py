"""Extraction of repositories: what a forge lists is landed as it comes, then turned into rows of the tables.

A phase is a few Spark jobs over all repositories together. Each answer is written before anything is
derived from it. A run begins each repository where the last finished one ended (its watermark, kept with the
tables, less an overlap, which rows that the tables have absorb), so it asks for newer commits only, and
stops listing requests at the first page of older ones; full asks for everything.

A path that fails ends nothing but itself: what else its repository answered goes into the tables, the
path goes to the table of dead letters, and other repositories finish. The next run goes on with the
answers that an unfinished repository has landed and asks only for the missing ones; after a number of
attempts a path is given up. Answers are deleted once all repositories of their run have finished.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field, replace
from functools import reduce
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forgelens.config import Config
from forgelens.operators import identity
from forgelens.schemas import schema_of
from forgelens.sources import forge, rest
from forgelens.sources.files import IdentityFile, Progress, key_of
from forgelens.sources.warehouse import Warehouse

# Paths of the two APIs; {..} are columns.
PATHS = {
    "github": {
        "repos": "/orgs/{group}/repos?type=all&sort=updated", "branches": "/repos/{repo}/branches", "commits": "/repos/{repo}/commits?sha={branch}{span}",
        "detail": "/repos/{repo}/commits/{commit_sha}", "requests": "/repos/{repo}/pulls?state=all&sort=updated&direction=desc", "links": "/repos/{repo}/pulls/{mr_iid}/commits",
    },
    "gitlab": {
        "repos": "/groups/{group}/projects?include_subgroups=true", "project": "/projects/{encoded}", "branches": "/projects/{id}/repository/branches",
        "commits": "/projects/{id}/repository/commits?with_stats=true&ref_name={branch}{span}", "detail": "/projects/{id}/repository/commits/{commit_sha}/diff",
        "requests": "/projects/{id}/merge_requests?state=all&order_by=updated_at&sort=desc", "links": "/projects/{id}/merge_requests/{mr_iid}/commits",
    },
}
_LISTED = "archived boolean, empty_repo boolean, full_name string, path_with_namespace string"
_BRANCH = "name string, commit struct<committed_date: string>"
_PEOPLE = ("author_name", "author_email", "committer_name", "committer_email")


#: What a repository has to have answered before its commits, and before its requests, are complete.
_COMMITS, _REQUESTS = ("project", "branches", "commits", "detail"), ("requests", "links")


@dataclass(frozen=True)
class Extraction:
    """since, until: days that hold for all repositories; without since each begins at its watermark. overlap_hours: what is listed again before it, at
    least the 14 hours that clocks of commits may differ. attempts: runs after which a failing path is given up; tries: of one request within a run."""

    spark: SparkSession
    store: Warehouse
    config: Config
    since: str | None = None
    until: str | None = None
    transport: str = ""
    tasks: int = 8
    seconds: float | None = None
    full: bool = False
    overlap_hours: int = 24
    attempts: int = 5
    tries: int = rest.ATTEMPTS
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def _ask(self, rows: DataFrame, what: str) -> DataFrame:
        """Landed answers: the rows' columns, pos and body. Only paths that this run has no answer to are asked."""
        parts, template = [], PATHS[self.config.provider][what]
        while "{" in template:
            before, _, rest_ = template.partition("{")
            name, _, template = rest_.partition("}")
            parts += [F.lit(before), F.url_encode(F.col(name)) if name == "branch" else F.col(name)]
        asked = rows.withColumn("path", F.concat(*parts, F.lit(template)))
        seconds = rest.SPACING[self.config.provider] if self.seconds is None else self.seconds
        path = self.store.landed(self.name, what)
        if self.store.exists(path):
            asked = asked.join(self._ends(what).filter(F.col("answered") | (F.col("attempts") >= self.attempts)), "path", "left_anti").select(*asked.columns)
        rest.fetched(asked, self.config.base_url, self.config.token_env, self.transport, self.tasks, seconds, self.tries).write.mode("append").parquet(path)
        return self.spark.read.parquet(path).filter("body is not null").drop("path", "error")

    def _ends(self, what: str) -> DataFrame:
        """Per path of this run whether it is answered, how often it was asked, and why it failed."""
        ends = self.spark.read.parquet(self.store.landed(self.name, what)).filter("pos is null")
        repo = F.any_value("repo") if "repo" in ends.columns else F.lit(None).cast("string")
        return ends.groupBy("path").agg(repo.alias("repo"), F.bool_or(F.col("error").isNull()).alias("answered"), F.count("*").cast("int").alias("attempts"), F.max("error").alias("error"))

    def failures(self, *whats: str) -> DataFrame:
        """Paths without an answer, as rows of dead_letters."""
        out = self.spark.createDataFrame([], schema_of("dead_letters"))
        now = F.current_timestamp().cast("timestamp_ntz")
        for what in whats:
            if self.store.exists(self.store.landed(self.name, what)):
                out = out.unionByName(self._ends(what).filter("not answered").select("repo", F.lit(what).alias("what"), "path", "error", "attempts", (F.col("attempts") >= self.attempts).alias("given_up"), now.alias("noted_at")))
        return out

    @property
    def github(self) -> bool:
        return self.config.provider == "github"

    def listed_repos(self, group: str) -> DataFrame:
        """Paths of a group's repositories that are neither archived nor empty."""
        found = self._ask(self.spark.createDataFrame([(quote(group, safe=""),)], "group string"), "repos").select(F.from_json("body", _LISTED).alias("r"))
        return found.filter(~F.coalesce("r.archived", "r.empty_repo", F.lit(False))).select(F.col("r.full_name" if self.github else "r.path_with_namespace").alias("repo"))

    def projects(self, repos: tuple[str, ...]) -> DataFrame:
        """repo, id, name (as it is configured), since and span; on GitLab repositories are asked for by id or path, and ids that don't exist are left out."""
        if self.github:
            found = self.spark.createDataFrame([(r, r, r) for r in repos], "repo string, id string, name string")
        else:
            asked = self.spark.createDataFrame([(r, quote(r, safe="")) for r in repos], "repo string, encoded string")
            answers = self._ask(asked, "project").withColumnRenamed("repo", "name")
            found = answers.select("name", F.from_json("body", "id string, path_with_namespace string").alias("p")).select(F.col("p.path_with_namespace").alias("repo"), "p.id", "name")
        return self._begun(found)

    def _begun(self, projects: DataFrame) -> DataFrame:
        """With since, where listing begins, and span, as it is asked for."""
        day, end = ("T00:00:00Z", "T23:59:59Z") if self.github else ("", "")
        if self.since or self.full:
            found = projects.withColumn("since", F.lit(self.since + day if self.since else None).cast("string"))
        else:
            marks = self.store.table("watermarks").groupBy("repo").agg(F.max("since").alias("mark"))
            begin = F.date_format(F.col("mark") - F.make_dt_interval(hours=F.lit(self.overlap_hours)), "yyyy-MM-dd'T'HH:mm:ss'Z'")
            found = projects.join(marks, "repo", "left").withColumn("since", begin).drop("mark")
        until = f"&until={self.until}{end}" if self.until else ""
        return found.withColumn("span", F.concat(F.coalesce(F.concat(F.lit("&since="), "since"), F.lit("")), F.lit(until)))

    def watermarks(self, repos: list[str]) -> DataFrame:
        """repo and since: the last commit that the run or the tables have of each."""
        text = F.coalesce(*[F.get_json_object("body", p) for p in (("$.commit.committer.date",) if self.github else ("$.committed_date",))])
        seen = [self.spark.read.parquet(p).filter("body is not null").select("repo", F.try_to_timestamp(text).cast("timestamp_ntz").alias("since")) for what in ("commits", "detail") if self.store.exists(p := self.store.landed(self.name, what))]
        stored = self.store.table("commits").select(F.col("project_path").alias("repo"), F.col("committed_date").alias("since"))
        rows = reduce(DataFrame.unionByName, [stored, *seen]).filter(F.col("repo").isin(*repos) & F.col("since").isNotNull())
        return rows.groupBy("repo").agg(F.max("since").alias("since"))

    def commits(self, projects: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(commits, diffs) that the tables don't have, of the first branch that lists each; merged and without bots."""
        branches = self._ask(projects, "branches").withColumn("b", F.from_json("body", _BRANCH))
        branches = branches.select("repo", "id", "since", "span", F.col("b.name").alias("branch"), F.col("pos").alias("branch_ord"), F.col("b.commit.committed_date").alias("last_commit_date"))
        if not self.github:
            branches = forge.active_branches(branches, F.col("since"))
        listed = self._ask(branches.drop("last_commit_date", "since"), "commits")
        sha = F.get_json_object("body", "$.sha" if self.github else "$.id")
        stubs = forge.first_branch_wins(listed.select(sha.alias("commit_sha"), "repo", "id", "branch", "branch_ord", "pos", "body"))
        new = forge.not_stored(stubs, self.store.table("commits"), "commit_sha")
        detail = self._ask(new.select("commit_sha", "repo", "id", "branch", F.col("body").alias("stub")), "detail")
        raw = self._raw_commits(detail)
        commits = forge.github_commits(raw, F.col("repo")) if self.github else forge.gitlab_commits(raw, F.col("project_id"), F.col("repo"))
        people = forge.without_excluded(forge.without_bots(commits, self.config.bot_names), self.config.excluded)
        people = forge.not_stored(people, self.store.table("commits"), "commit_sha")  # answers that an earlier attempt has used are landed still
        diffs = (forge.github_diffs if self.github else forge.gitlab_diffs)(raw)
        return people, diffs.join(people.select("commit_sha"), "commit_sha", "left_semi")

    def _raw_commits(self, detail: DataFrame) -> DataFrame:
        if self.github:
            return detail.select("repo", F.from_json("body", forge.GITHUB_COMMIT).withField("branch", F.col("branch")).alias("c")).select("repo", "c.*")
        files = F.transform(F.array_sort(F.collect_list(F.struct("pos", "body"))), lambda x: x["body"])
        rows = detail.groupBy("commit_sha", "repo", "id", "branch", "stub").agg(files.alias("files"))
        stub = F.from_json("stub", forge.GITLAB_COMMIT)
        diffs = F.from_json(F.concat(F.lit("["), F.array_join("files", ","), F.lit("]")), "array<struct<old_path: string, new_path: string, diff: string, new_file: boolean, renamed_file: boolean, deleted_file: boolean>>")
        return rows.select("repo", F.col("id").alias("project_id"), stub.withField("branch", F.col("branch")).withField("diffs", diffs).alias("c")).select("repo", "project_id", "c.*")

    def requests(self, projects: DataFrame) -> DataFrame:
        schema = forge.GITHUB_PULL if self.github else forge.GITLAB_MERGE
        raw = self._ask(projects.withColumn("enough_before", F.col("since")), "requests").withColumnRenamed("id", "project")
        raw = raw.select("repo", "project", "since", F.from_json("body", schema).alias("m")).select("repo", "project", "since", "m.*")
        day = F.substring("updated_at", 1, 10)
        raw = raw.filter(F.col("since").isNull() | (day >= F.substring("since", 1, 10)))
        raw = raw.filter(day <= self.until) if self.until and not self.github else raw  # the other forge's requests are bound by since only
        rows = forge.github_merge_requests(raw, F.col("repo")) if self.github else forge.gitlab_merge_requests(raw, F.col("project"), F.col("repo"))
        people = forge.without_excluded(forge.without_bots(rows, self.config.bot_names), self.config.excluded)
        return forge.not_stored(people.dropDuplicates(["mr_id"]), self.store.table("merge_requests"), "mr_id")

    def links(self, projects: DataFrame) -> DataFrame:
        """Commits of the stored requests of these projects that have none yet."""
        stored = self.store.table("merge_requests").select("mr_id", "mr_iid", "project_id")
        mine = projects.select("repo", "id").join(stored, F.col("repo" if self.github else "id") == F.col("project_id"))
        missing = forge.requests_missing_links(mine, self.store.table("mr_commits")).select("repo", "id", "mr_id", "mr_iid", "project_id")
        sha = F.get_json_object("body", "$.sha" if self.github else "$.id").alias("commit_sha")
        found = self._ask(missing, "links").select("mr_id", "mr_iid", sha, "project_id").distinct()
        return forge.not_stored(found, self.store.table("mr_commits"), "mr_id", "commit_sha")

    def _hashed(self, rows: DataFrame, columns: tuple[str, ...], people: IdentityFile | None) -> DataFrame:
        """Pseudonyms instead of names and addresses, which go to the file of people."""
        if not (self.config.anonymize and self.config.key):
            return rows
        key = key_of(self.config.key)
        aliases = self.spark.createDataFrame(list(self.config.aliases.items()) or [], "alias string, canonical string") if self.config.aliases else None
        if people is not None:  # who the stored pseudonyms are: those of resolved addresses
            known = rows if aliases is None else identity.resolve_aliases(rows, "author_email", aliases)
            found = identity.identity_map(known, key, "created_at").collect()  # one row a person
            people.add({r["hash"]: (r["name"], r["email"]) for r in found})
        return identity.anonymized(rows, columns, key, aliases)

    def run(self, progress: Progress, people: IdentityFile | None = None) -> dict[str, int]:
        """Rows added by table. Repositories that an earlier run hasn't finished go on with what they have landed; those that fail stay unfinished."""
        runs: dict[str, list[str]] = {}
        for r in self.config.repos:
            runs.setdefault((progress.load(r) or {}).get("run") or self.name, []).append(r)
        added = dict.fromkeys(("commits", "diffs", "merge_requests", "mr_commits"), 0)
        for name, repos in runs.items():
            for table, n in replace(self, name=name)._run(tuple(repos), progress, people).items():
                added[table] += n
        return added

    def _run(self, repos: tuple[str, ...], progress: Progress, people: IdentityFile | None) -> dict[str, int]:
        added = dict.fromkeys(("commits", "diffs", "merge_requests", "mr_commits"), 0)

        def put(table: str, rows: DataFrame) -> None:
            before = self.store.count(table)
            self.store.insert(table, rows)
            added[table] += self.store.count(table) - before

        def reach(names: list[str] | tuple[str, ...], phase: str) -> None:
            for r in names:
                progress.save(r, phase=phase, run=self.name)

        reached = {r: (progress.load(r) or {}).get("phase") for r in repos}
        first = tuple(r for r in repos if reached[r] != "requests")
        reach(first, "commits")
        reach([r for r in repos if r not in first], "requests")
        projects = self.projects(repos)
        named = {r["repo"]: r["name"] for r in projects.select("repo", "name").collect()}  # one row a repository
        failed = lambda *whats: {named.get(r[0], r[0]) for r in self.failures(*whats).filter("not given_up").select("repo").distinct().collect()}
        if first:
            commits, diffs = self.commits(projects.filter(F.col("name").isin(*first)))
            put("diffs", forge.not_stored(diffs, self.store.table("diffs"), "commit_sha"))  # before the commits, which a new run takes as finished
            put("commits", self._hashed(commits, _PEOPLE, people))
            missing = failed(*_COMMITS)
            reach([r for r in first if r not in missing], "requests")
        put("merge_requests", self._hashed(self.requests(projects), _PEOPLE[:2], people))
        put("mr_commits", self.links(projects))
        self.store.insert("dead_letters", self.failures(*_COMMITS, *_REQUESTS))
        missing = failed(*_COMMITS, *_REQUESTS)
        done = [repo for repo, name in named.items() if name not in missing]
        if done and not (self.since or self.until):
            self.store.insert("watermarks", self.watermarks(done).withColumn("noted_at", F.current_timestamp().cast("timestamp_ntz")))
        for r in repos:
            if r not in missing:
                progress.clear(r)
        if not missing:
            self.store.drop_landed(self.name)
        return added
