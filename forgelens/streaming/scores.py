"""Scores of commits as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from forgelens.operators import scoring
from forgelens.sources.warehouse import Warehouse


def score_batch(warehouse: Warehouse, commits: DataFrame, query: str, batch: int, scorer: scoring.Scorer | str | None = None, **how: int) -> None:
    """Scores of some commits, in both tables under one name: the same batch again replaces what a broken attempt has left, and adds nothing once it is whole.

    how: tasks and in_flight of scoring.scored_by. Commits without diffs get no score.
    """
    name = f"{query}-{batch}"
    if warehouse.has_batch(name):
        return
    commits = commits.select("commit_sha", "title", "message").persist()
    diffs = warehouse.table("diffs").join(commits.select("commit_sha"), "commit_sha", "left_semi")
    if scorer is None:
        files, categories = scoring.ruled(diffs)
    else:
        path = warehouse.landed(f"batch-{name}", "replies")
        scoring.scored_by(scoring.commit_bundles(commits, diffs), scorer, **how).write.mode("overwrite").parquet(path)
        files = scoring.reply_files(warehouse.spark.read.parquet(path))
        categories = files.select("commit_sha", "overall_category").distinct()
    scored = scoring.scored_files(files, diffs.withColumn("last", scoring.last_extracted()), "last").persist()
    now = F.current_timestamp().cast("timestamp_ntz").alias("scored_at")
    warehouse.insert_batch(name, {"file_scores": scoring.file_score_rows(scored).select("*", now), "commit_scores": scoring.commit_score_rows(scored, categories).select("*", now)})
    warehouse.drop_landed(f"batch-{name}")
    scored.unpersist()
    commits.unpersist()


def score_stream(commits: DataFrame, warehouse: Warehouse, checkpoint: str, query: str = "scores", delay: str = "7 days", scorer: scoring.Scorer | str | None = None, **how: int) -> StreamingQuery:
    """Scores a stream of rows of commits, each commit_sha once.

    That a commit has been seen is state that lasts for delay behind the newest extracted_at, so it doesn't grow with
    the table and the table isn't read; a commit that comes again later than that is scored again. query names what it writes: another checkpoint needs
    another name. Diffs have to be there before their commits, as extraction writes them.
    """
    seen = commits.withColumn("at", F.col("extracted_at").cast("timestamp")).withWatermark("at", delay).dropDuplicatesWithinWatermark(["commit_sha"])
    take = lambda rows, batch: score_batch(warehouse, rows, query, batch, scorer, **how)
    return seen.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
