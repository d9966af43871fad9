"""From the forges' nested API objects to rows of the tables.

Inputs are DataFrames of landed JSON (``read_json``) with the API's own fields. Nothing here asks a
network; ``sources.rest`` does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from forgelens.functions.columns import added_lines, deleted_lines, is_known_bot, utc_timestamp
from forgelens.schemas import schema_of

GITHUB_COMMIT = (
    "sha string, html_url string, branch string, commit struct<author: struct<name: string, email: string, date: string>,"
    " committer: struct<name: string, email: string, date: string>, message: string>, stats struct<additions: int, deletions: int, total: int>,"
    " parents array<struct<sha: string>>, files array<struct<filename: string, previous_filename: string, status: string, patch: string, additions: int, deletions: int>>"
)
GITLAB_COMMIT = (
    "id string, title string, message string, author_name string, author_email string, committer_name string, committer_email string, authored_date string, committed_date string,"
    " created_at string, web_url string, branch string, parent_ids array<string>, stats struct<additions: int, deletions: int, total: int>,"
    " diffs array<struct<old_path: string, new_path: string, diff: string, new_file: boolean, renamed_file: boolean, deleted_file: boolean>>"
)
GITHUB_PULL = (
    "id bigint, number bigint, title string, body string, state string, user struct<login: string>, created_at string, updated_at string, merged_at string, closed_at string,"
    " head struct<ref: string>, base struct<ref: string>, additions int, deletions int, html_url string, commits array<struct<sha: string>>"
)
GITLAB_MERGE = (
    "id bigint, iid bigint, title string, description string, state string, author struct<name: string, email: string>, created_at string, updated_at string, merged_at string,"
    " closed_at string, source_branch string, target_branch string, web_url string, commits array<struct<id: string>>"
)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Landed API pages: one object a line, or a list in a file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def _conform(rows: DataFrame, table: str, at: Column | None = None) -> DataFrame:
    have = set(rows.columns)
    now = (at if at is not None else F.current_timestamp()).cast("timestamp_ntz")
    return rows.select([(F.col(f.name) if f.name in have else now if f.name == "extracted_at" else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema_of(table)])


def _column(value: str | Column) -> Column:
    return F.lit(value) if isinstance(value, str) else value


def _last(path: str | Column) -> Column:
    """A path's last segment."""
    return F.element_at(F.split(_column(path), "/"), -1)


def first_line(text: Column, limit: int) -> Column:
    return F.substring(F.substring_index(F.coalesce(text, F.lit("")), "\n", 1), 1, limit)


def marked(text: Column, limit: int) -> Column:
    """Cut, with a mark where something went."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("\n... [truncated]"))).otherwise(text)


def github_commits(raw: DataFrame, project_path: str | Column, at: Column | None = None) -> DataFrame:
    who, by = F.col("commit.author"), F.col("commit.committer")
    rows = raw.select(
        F.col("sha").alias("commit_sha"), _column(project_path).alias("project_id"), _last(project_path).alias("project_name"), _column(project_path).alias("project_path"),
        who["name"].alias("author_name"), who["email"].alias("author_email"), by["name"].alias("committer_name"), by["email"].alias("committer_email"),
        utc_timestamp(who["date"]).alias("authored_date"), utc_timestamp(by["date"]).alias("committed_date"), utc_timestamp(who["date"]).alias("created_at"), F.col("branch").alias("branch_name"),
        first_line(F.col("commit.message"), 255).alias("title"), F.substring("commit.message", 1, 5000).alias("message"), F.col("stats.additions").alias("additions"),
        F.col("stats.deletions").alias("deletions"), F.col("stats.total").alias("total_changes"), F.array_join(F.transform("parents", lambda p: p["sha"]), ",").alias("parent_ids"), F.col("html_url").alias("web_url"),
    )
    return _conform(rows, "commits", at)


def gitlab_commits(raw: DataFrame, project_id: str | Column, project_path: str | Column, at: Column | None = None) -> DataFrame:
    """Commits with a diff only."""
    rows = raw.filter(F.size("diffs") > 0).select(
        F.col("id").alias("commit_sha"), _column(project_id).alias("project_id"), _last(project_path).alias("project_name"), _column(project_path).alias("project_path"),
        "author_name", "author_email", "committer_name", "committer_email", *[utc_timestamp(F.col(c)).alias(c) for c in ("authored_date", "committed_date", "created_at")], F.col("branch").alias("branch_name"),
        F.substring("title", 1, 1000).alias("title"), F.substring("message", 1, 5000).alias("message"), F.col("stats.additions").alias("additions"), F.col("stats.deletions").alias("deletions"),
        F.col("stats.total").alias("total_changes"), F.array_join("parent_ids", ",").alias("parent_ids"), "web_url",
    )
    return _conform(rows, "commits", at)


def github_diffs(raw: DataFrame, at: Column | None = None) -> DataFrame:
    rows = raw.select(F.col("sha").alias("commit_sha"), F.explode("files").alias("f")).select(
        "commit_sha", F.col("f.filename").alias("file_path"), F.coalesce("f.previous_filename", "f.filename").alias("old_path"), F.col("f.filename").alias("new_path"), marked(F.col("f.patch"), 50_000).alias("diff"),
        (F.col("f.status") == "added").alias("new_file"), (F.col("f.status") == "renamed").alias("renamed_file"), (F.col("f.status") == "removed").alias("deleted_file"), "f.additions", "f.deletions",
    )
    return _conform(rows, "diffs", at)


def gitlab_diffs(raw: DataFrame, at: Column | None = None) -> DataFrame:
    """The path is the new one, or the old one where that is missing or empty; lines are counted in the diff."""
    rows = raw.select(F.col("id").alias("commit_sha"), F.explode("diffs").alias("f")).select("commit_sha", "f.*")
    rows = rows.withColumns({"file_path": F.coalesce(F.nullif("new_path", F.lit("")), "old_path"), "additions": added_lines(F.col("diff")), "deletions": deleted_lines(F.col("diff"))})
    return _conform(rows.withColumn("diff", F.substring("diff", 1, 50_000)), "diffs", at)


def merge_state(merged_at: Column, state: Column) -> Column:
    return F.when(merged_at.isNotNull(), "merged").when(state == "closed", "closed").otherwise("opened")


def github_merge_requests(raw: DataFrame, project_path: str | Column, at: Column | None = None) -> DataFrame:
    rows = raw.select(
        F.col("id").cast("string").alias("mr_id"), F.col("number").cast("string").alias("mr_iid"), _column(project_path).alias("project_id"), _last(project_path).alias("project_name"),
        F.substring("title", 1, 1000).alias("title"), F.substring("body", 1, 5000).alias("description"), merge_state(F.col("merged_at"), F.col("state")).alias("state"), F.col("user.login").alias("author_name"),
        F.lit("").alias("author_email"), *[utc_timestamp(F.col(c)).alias(c) for c in ("created_at", "updated_at", "merged_at", "closed_at")], F.col("head.ref").alias("source_branch"),
        F.col("base.ref").alias("target_branch"), "additions", "deletions", F.col("html_url").alias("web_url"),
    )
    return _conform(rows, "merge_requests", at)


def gitlab_merge_requests(raw: DataFrame, project_id: str | Column, project_path: str | Column, at: Column | None = None) -> DataFrame:
    rows = raw.select(
        F.col("id").cast("string").alias("mr_id"), F.col("iid").cast("string").alias("mr_iid"), _column(project_id).alias("project_id"), _last(project_path).alias("project_name"),
        F.substring("title", 1, 1000).alias("title"), F.substring("description", 1, 5000).alias("description"), "state", F.col("author.name").alias("author_name"), F.col("author.email").alias("author_email"),
        *[utc_timestamp(F.col(c)).alias(c) for c in ("created_at", "updated_at", "merged_at", "closed_at")], "source_branch", "target_branch", "web_url",
    )
    return _conform(rows, "merge_requests", at)


def merge_links(raw: DataFrame, project_id: str | Column, number: str = "number", sha: str = "sha", at: Column | None = None) -> DataFrame:
    """One row for each commit of each merge request."""
    rows = raw.select(F.col("id").cast("string").alias("mr_id"), F.col(number).cast("string").alias("mr_iid"), F.explode("commits").alias("c"))
    return _conform(rows.select("mr_id", "mr_iid", F.col(f"c.{sha}").alias("commit_sha"), _column(project_id).alias("project_id")), "mr_commits", at)


def first_branch_wins(stubs: DataFrame, key: str = "commit_sha", order: tuple[str, ...] = ("branch_ord", "pos")) -> DataFrame:
    """Of a commit that several branches list, the first in listing order: a minimum, which each task takes for its own rows first."""
    first = F.min(F.struct(*order, *[c for c in stubs.columns if c not in (key, *order)])).alias("first")
    return stubs.groupBy(key).agg(first).select(key, "first.*").select(*stubs.columns)


def not_stored(rows: DataFrame, stored: DataFrame, *keys: str) -> DataFrame:
    return rows.join(stored.select(*keys).distinct(), list(keys), "left_anti")


def without_bots(rows: DataFrame, more_names: tuple[str, ...] = ()) -> DataFrame:
    return rows.filter(~is_known_bot(F.col("author_name"), F.col("author_email"), more_names))


def without_excluded(rows: DataFrame, excluded: tuple[str, ...], columns: tuple[str, ...] = ("author_name", "author_email")) -> DataFrame:
    """Exact names and addresses; null ones stay."""
    for c in columns if excluded else ():
        rows = rows.filter(~F.coalesce(F.col(c).isin(*excluded), F.lit(False)))
    return rows


def active_branches(branches: DataFrame, since: str | Column) -> DataFrame:
    """Branches whose last commit is not before the day; those without a date stay, and where there is no day all do."""
    day = _column(since)
    return branches.filter(F.col("last_commit_date").isNull() | day.isNull() | (F.substring("last_commit_date", 1, 10) >= F.substring(day, 1, 10)))


def updated_within(requests: DataFrame, since: str, until: str | None = None) -> DataFrame:
    """By day of the last update, both ends included."""
    day = F.col("updated_at").cast("date")
    where = day >= F.lit(since).cast("date")
    return requests.filter(where & (day <= F.lit(until).cast("date")) if until else where)


def commits_missing_diffs(commits: DataFrame, diffs: DataFrame) -> DataFrame:
    return commits.join(diffs.select("commit_sha").distinct(), "commit_sha", "left_anti")


def requests_missing_links(requests: DataFrame, links: DataFrame) -> DataFrame:
    return requests.join(links.select("project_id", "mr_iid").distinct(), ["project_id", "mr_iid"], "left_anti")


def high_watermark(commits: DataFrame) -> DataFrame:
    return commits.groupBy("project_path").agg(F.max("committed_date").alias("high_watermark"))
