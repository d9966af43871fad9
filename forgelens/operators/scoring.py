"""Scores of changes: which commits lack one, what a scorer sees, and what its replies come to."""

from __future__ import annotations

import importlib
import json
import re
import time
import uuid
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from forgelens.functions.columns import auto_score, capped_score, parsed_reply, truncated, valid_category
from forgelens.sources.lease import Lease
from forgelens.sources.warehouse import Warehouse

#: Diff lengths that a scorer is given, from the first attempt to the last.
ATTEMPTS = (10_000, 2_000, 1_000)
#: Replies that a task passes on together.
REPLIES = 50


def unscored_commits(commits: DataFrame, scores: DataFrame, excluded: tuple[str, ...] = ()) -> DataFrame:
    """Commits without a score, except of excluded e-mails or names (without regard to case); the newest first."""
    rows = commits.join(scores.select("commit_sha").distinct(), "commit_sha", "left_anti")
    if excluded:
        low = [x.lower() for x in excluded]
        for c in ("author_email", "author_name"):
            rows = rows.filter(~F.coalesce(F.lower(c).isin(*low), F.lit(False)))
    return rows.orderBy(F.desc_nulls_last("committed_date"), "commit_sha")


def commit_bundles(commits: DataFrame, diffs: DataFrame) -> DataFrame:
    """Per commit its files in order of path, as an array of structs."""
    files = diffs.groupBy("commit_sha").agg(F.array_sort(F.collect_list(F.struct("file_path", "additions", "deletions", "diff"))).alias("files"))
    return commits.join(files, "commit_sha")


def prompts(bundles: DataFrame, attempt: int = 0) -> DataFrame:
    """commit_sha and the text for a scorer: title, message, files with line counts, and diffs of files without a fixed score."""
    return bundles.select("commit_sha", _prompt(ATTEMPTS[min(attempt, len(ATTEMPTS) - 1)]).alias("prompt"))


def _prompt(limit: int) -> Column:
    """With diffs of at most so many characters; every file stays in the list."""
    count = lambda n: F.coalesce(n, F.lit(0)).cast("string")
    listed = F.transform("files", lambda f: F.concat(F.lit("- "), f["file_path"], F.lit(" (+"), count(f["additions"]), F.lit("/-"), count(f["deletions"]), F.lit(")")))
    shown = F.transform(F.filter("files", lambda f: auto_score(f["file_path"]).isNull()), lambda f: F.concat(F.lit("### "), f["file_path"], F.lit("\n"), truncated(f["diff"], limit)))
    message = F.concat(F.lit("Message: "), F.substring(F.coalesce("message", "title", F.lit("")), 1, 500))
    return F.concat_ws("\n", F.concat(F.lit("Title: "), F.coalesce("title", F.lit(""))), message, F.lit("Files:"), F.array_join(listed, "\n"), F.array_join(shown, "\n"))


class RateLimited(Exception):
    """What a scorer raises when it was asked too often."""


def ask(scorer: Callable[[str], str], attempts: list[str], sleep: Callable[[float], None] = time.sleep) -> str | None:
    """The first reply that holds a list of files, from the longest prompt to the shortest; None after the last. A scorer that was asked too often gets 2, 4, 8 s."""
    for i, prompt in enumerate(attempts):
        try:
            reply = scorer(prompt)
            if has_files(reply):
                return reply
        except RateLimited:
            sleep(2.0 * 2**i)
            continue
        except Exception:  # noqa: BLE001, S110 - whatever a client raises, the next attempt is shorter
            pass
        if i + 1 < len(attempts):
            sleep(0.5)
    return None


def has_files(reply: str | None) -> bool:
    """Whether there is an object with files, in code fences or amid other text; columns.parsed_reply reads it."""
    found = re.search(r"\{.*\}", reply or "", re.DOTALL)
    try:
        return bool(found) and isinstance(json.loads(found[0]).get("files"), list)
    except ValueError:
        return False


Scorer = Callable[[str], str]


def named(scorer: Scorer | str) -> Scorer:
    """A scorer, or the one that module:function names."""
    if not isinstance(scorer, str):
        return scorer
    module, _, attribute = scorer.partition(":")
    return getattr(importlib.import_module(module), attribute)


def in_order(call: Callable[[object], object], items: Iterable[object], in_flight: int) -> Iterator[object]:
    """What call gives for each item, in the items' order, with so many calls at a time; no more than twice as many items are held."""
    with ThreadPoolExecutor(in_flight) as pool:
        waiting: deque = deque()
        for item in items:
            if len(waiting) >= 2 * in_flight:
                yield waiting.popleft().result()
            waiting.append(pool.submit(call, item))
        while waiting:
            yield waiting.popleft().result()


def scored_by(bundles: DataFrame, scorer: Scorer | str, tasks: int = 8, sleep: Callable[[float], None] = time.sleep, in_flight: int = 1, lease: Lease | None = None) -> DataFrame:
    """commit_sha and a scorer's reply to each bundle, null after the last failed attempt. Write the result before reading it twice: each reading asks again.

    At most tasks times in_flight calls are made at a time; a lease bounds how many all tasks together begin in a window of time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = named(scorer)

        def asked_in_turn(prompt: str) -> str:
            if lease:
                lease.take()
            return own(prompt)

        rows = ((sha, list(attempts)) for b in batches for sha, attempts in zip(b["commit_sha"], b["prompts"]))
        found = in_order(lambda row: (row[0], ask(asked_in_turn, row[1], sleep)), rows, in_flight)
        while part := list(islice(found, REPLIES)):
            yield pd.DataFrame(part, columns=["commit_sha", "reply"])

    asked = bundles.select("commit_sha", F.array(*[_prompt(limit) for limit in ATTEMPTS]).alias("prompts"))
    return asked.repartition(tasks).mapInPandas(run, "commit_sha string, reply string")


def rule_scores(diffs: DataFrame) -> DataFrame:
    """file scores without a model: the fixed score of trivial files, else a share of added lines; one category by path."""
    path, lines = F.col("file_path"), F.coalesce("additions", F.lit(0)) + F.coalesce("deletions", F.lit(0))
    share = F.when(lines > 0, F.lit(0.25) + F.lit(0.25) * F.coalesce("additions", F.lit(0)) / lines).otherwise(0.0)
    category = F.when(path.rlike(r"(?i)(^|/)tests?/"), "test").when(path.rlike(r"(?i)\.md$"), "docs").when(path.rlike(r"(?i)\.(json|ya?ml|toml|ini)$"), "config").otherwise("feature")
    return diffs.select("commit_sha", "file_path", F.coalesce(auto_score(path), share).alias("score"), category.alias("category"))


def ruled(diffs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, categories) by rule, as replies would give them; a commit's category is that of its highest score."""
    rows = rule_scores(diffs).withColumns({"reasoning": F.lit("by rule"), "overall_category": F.col("category")})
    largest = F.max_by("category", F.struct(F.coalesce("score", F.lit(0.0)), "file_path"))
    return rows, rows.groupBy("commit_sha").agg(largest.alias("overall_category"))


def last_extracted() -> Column:
    """By what the last of several diffs of one path is found: the time, then the largest."""
    return F.struct("extracted_at", "additions", "deletions", "diff")


def reply_files(replies: DataFrame) -> DataFrame:
    """One row a file of each reply that can be read; reply columns: commit_sha, reply."""
    parsed = replies.withColumn("r", parsed_reply(F.col("reply"))).filter(F.col("r").isNotNull())
    files = parsed.select("commit_sha", F.col("r.overall_category").alias("overall_category"), F.posexplode("r.files").alias("pos", "f"))
    return files.select("commit_sha", "overall_category", "pos", F.col("f.path").alias("file_path"), "f.score", "f.category", "f.reasoning")


def scored_files(files: DataFrame, diffs: DataFrame, order: str | None = None) -> DataFrame:
    """Scores of files that the commit has, capped, with p = score times added lines (1 at least). If a commit has a path twice, the last by order counts."""
    counts = diffs.select("commit_sha", "file_path", F.coalesce("additions", F.lit(0)).alias("adds"), F.coalesce("deletions", F.lit(0)).alias("dels"), *([order] if order else []))
    if order:
        last = Window.partitionBy("commit_sha", "file_path").orderBy(F.desc(order))
        counts = counts.withColumn("rn", F.row_number().over(last)).filter("rn = 1").drop("rn", order)
    rows = files.join(counts, ["commit_sha", "file_path"]).withColumn("lines", F.col("adds") + F.col("dels"))
    score = capped_score(F.col("file_path"), F.coalesce("score", F.lit(0.0)), F.col("lines"))
    return rows.withColumn("score", score).withColumns({"p": F.col("score") * F.greatest("adds", F.lit(1)), "category": valid_category(F.col("category"))})


def commit_productivity(scored: DataFrame) -> DataFrame:
    """Per commit the sum of p, and that over all lines (0 without lines), rounded to 4 digits."""
    p, lines = F.sum("p"), F.sum("lines")
    four = lambda c: F.round(c.cast("decimal(38,10)"), 4).cast("double")
    return scored.groupBy("commit_sha").agg(four(p).alias("total_productivity"), F.coalesce(four(p / F.nullif(lines, F.lit(0))), F.lit(0.0)).alias("weighted_score"))


def file_score_rows(scored: DataFrame) -> DataFrame:
    """For the file_scores table: rounded scores, reasons of 1000 characters at most."""
    return scored.select("commit_sha", "file_path", F.round("score", 4).alias("score"), "category", F.substring("reasoning", 1, 1000).alias("reasoning"))


def commit_score_rows(scored: DataFrame, categories: DataFrame) -> DataFrame:
    """For the commit_scores table; categories: commit_sha and the reply's overall_category."""
    overall = categories.groupBy("commit_sha").agg(F.min("overall_category").alias("overall_category"))
    return commit_productivity(scored).join(overall, "commit_sha", "left").select("commit_sha", "total_productivity", "weighted_score", F.coalesce("overall_category", F.lit("unknown")).alias("overall_category"))


def write_scores(warehouse: Warehouse, scored: DataFrame, categories: DataFrame) -> None:
    """Both score tables; commits that have scores already are left out, so a batch that is tried again adds nothing twice. File scores go first: a commit counts as scored only once all is there."""
    now = F.current_timestamp().cast("timestamp_ntz").alias("scored_at")
    old = warehouse.table("commit_scores").select("commit_sha").distinct()
    new = scored.join(old, "commit_sha", "left_anti")
    files = file_score_rows(new).join(warehouse.table("file_scores").select("commit_sha").distinct(), "commit_sha", "left_anti")
    warehouse.insert("file_scores", files.select("*", now))
    warehouse.insert("commit_scores", commit_score_rows(new, categories).select("*", now))


def score_commits(
    warehouse: Warehouse, scorer: Scorer | str | None = None, excluded: tuple[str, ...] = (), limit: int | None = None, tasks: int = 8, in_flight: int = 1, calls_a_second: int = 0
) -> int:
    """Scores the newest commits without a score, by a scorer or by rules; how many were added. Replies are landed first and go once the scores are written. Of several diffs of one path the last extracted counts, then the largest."""
    before = warehouse.count("commit_scores")
    todo = unscored_commits(warehouse.table("commits"), warehouse.table("commit_scores"), excluded)
    todo = todo.limit(limit) if limit else todo
    run = f"replies-{uuid.uuid4().hex}"
    diffs = warehouse.table("diffs").join(todo.select("commit_sha"), "commit_sha", "left_semi")
    if scorer is None:
        files, categories = ruled(diffs)
    else:
        path = warehouse.landed(run, "replies")
        lease = Lease(f"{warehouse.root}/_landed/{run}/lease", calls_a_second) if calls_a_second else None
        scored_by(commit_bundles(todo.select("commit_sha", "title", "message"), diffs), scorer, tasks, in_flight=in_flight, lease=lease).write.parquet(path)
        files = reply_files(warehouse.spark.read.parquet(path))
        categories = files.select("commit_sha", "overall_category").distinct()
    write_scores(warehouse, scored_files(files, diffs.withColumn("last", last_extracted()), "last"), categories)
    warehouse.drop_landed(run)
    return warehouse.count("commit_scores") - before


def scoring_summary(scores: DataFrame, scored: DataFrame) -> DataFrame:
    """Number, mean weighted score and total productivity of commits, with all lines."""
    lines = scored.agg(F.coalesce(F.sum("lines"), F.lit(0)).alias("total_lines"))
    four = lambda c: F.round(c.cast("decimal(38,10)"), 4).cast("double")
    return scores.agg(F.count("*").alias("n_commits"), four(F.avg("weighted_score")).alias("mean_weighted_score"), four(F.sum("total_productivity")).alias("total_productivity")).crossJoin(lines)


def category_counts(scores: DataFrame) -> DataFrame:
    """Category, number and whole per cent."""
    counts = scores.groupBy(F.coalesce("overall_category", F.lit("unknown")).alias("category")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("category", "n", F.floor(F.col("n") * 100 / F.col("total")).cast("long").alias("pct"))
