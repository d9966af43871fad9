"""The six tables."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {"s": T.StringType(), "i": T.IntegerType(), "d": T.DoubleType(), "b": T.BooleanType(), "t": T.TimestampNTZType(), "l": T.LongType(), "D": T.DateType()}


def _schema(spec: str) -> T.StructType:
    """Columns as name:kind, where no kind means a string."""
    pairs = (c.partition(":") for c in spec.split())
    return T.StructType([T.StructField(name, _TYPES[kind or "s"]) for name, _, kind in pairs])


SCHEMAS: dict[str, T.StructType] = {
    "commits": _schema(
        "commit_sha project_id project_name project_path author_name author_email committer_name committer_email authored_date:t committed_date:t"
        " created_at:t branch_name title message additions:i deletions:i total_changes:i parent_ids web_url extracted_at:t"
    ),
    "diffs": _schema("commit_sha file_path old_path new_path diff new_file:b renamed_file:b deleted_file:b additions:i deletions:i extracted_at:t"),
    "merge_requests": _schema(
        "mr_id mr_iid project_id project_name title description state author_name author_email created_at:t updated_at:t merged_at:t closed_at:t"
        " source_branch target_branch additions:i deletions:i web_url extracted_at:t"
    ),
    "mr_commits": _schema("mr_id mr_iid commit_sha project_id extracted_at:t"),
    "commit_scores": _schema("commit_sha total_productivity:d weighted_score:d overall_category scored_at:t"),
    "file_scores": _schema("commit_sha file_path score:d category reasoning scored_at:t"),
}

#: What is kept beside the tables: up to when a repository has been listed, answers that failed, and sums by day.
STATE: dict[str, T.StructType] = {
    "watermarks": _schema("repo since:t noted_at:t"),
    "dead_letters": _schema("repo what path error attempts:i given_up:b noted_at:t"),
    "activity": _schema("day:D project_path author_name author_email person:l again_sha again:l category commits:l lines:l additions:l scored:l productivity:d score:d score_n:l"),
}


def schema_of(table: str) -> T.StructType:
    known = SCHEMAS | STATE
    if table not in known:
        raise ValueError(f"unknown table {table!r}; known: {', '.join(SCHEMAS)}")
    return known[table]


def ddl(table: str, location: str | None = None) -> str:
    """CREATE TABLE IF NOT EXISTS for Spark SQL."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema_of(table))
    return f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet" + (f" LOCATION '{location}'" if location else "")
