"""Comparison of results with a stored snapshot, within a tolerance."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The line of counts, and words in the name of a metric that is compared as an integer.
INTEGER_WORDS = ("count", "commits", "unique_authors", "commit_count", "authors", "merged_count", "total_mrs")
TOP = 10
SCHEMA = "metric string, reference string, result string, status string, delta double"


def is_integer_metric(metric: Column) -> Column:
    """By the part after the last dot, so that an author's address doesn't count."""
    return F.lower(F.substring_index(metric, ".", -1)).rlike("|".join(INTEGER_WORDS))


def status_of(metric: Column, reference: Column, result: Column, tolerance: float = 0.01) -> Column:
    """PASS if equal, OK within the tolerance, else FAIL; text exactly, integer metrics by their whole part. NaN and infinities equal themselves only."""
    a, b = reference.try_cast("double"), result.try_cast("double")
    whole = F.when(a.try_cast("long") == b.try_cast("long"), "PASS").otherwise("FAIL")
    numbers = F.when(a == b, "PASS").when(is_integer_metric(metric), whole).when(F.abs(a - b) <= tolerance, "OK").otherwise("FAIL")
    return (
        F.when(reference.isNull() & result.isNull(), "PASS")
        .when(reference.isNull() | result.isNull(), "FAIL")
        .when(a.isNotNull() & b.isNotNull(), numbers)
        .otherwise(F.when(reference == result, "PASS").otherwise("FAIL"))
    )


def compared(pairs: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """metric, reference, result (as text) with status and delta."""
    metric, a, b = F.col("metric"), F.col("reference"), F.col("result")
    return pairs.select("metric", "reference", "result", status_of(metric, a, b, tolerance).alias("status"), F.abs(a.try_cast("double") - b.try_cast("double")).alias("delta"))


def compare_by_key(
    reference: DataFrame, result: DataFrame, key: str, metrics: tuple[str, ...], label: str, tolerance: float = 0.01, result_key: str | None = None, names: dict[str, str] | None = None, last: bool = True
) -> DataFrame:
    """Each metric that the reference has, of each of its rows, against the result's row of the same key; rows that the reference lacks are ignored, and without a known metric nothing is compared.

    names: what the result calls a metric of the reference. last: of several of the result's rows the last counts, else the first.
    """
    names, metrics = names or {}, tuple(m for m in metrics if m in reference.columns)
    if not metrics:
        return reference.sparkSession.createDataFrame([], SCHEMA)
    called = {m: next((n for n in (names.get(m, m), m) if n in result.columns), None) for m in metrics}
    named = result_key or key
    ours = result.select(
        (F.col(named).cast("string") if named in result.columns else F.lit(None).cast("string")).alias("k"), F.struct(*[(F.col(n).cast("string") if n else F.lit(None).cast("string")).alias(f"p_{m}") for m, n in called.items()]).alias("p"),
        F.monotonically_increasing_id().alias("at"),
    )
    ours = ours.groupBy("k").agg((F.max_by if last else F.min_by)("p", "at").alias("p")).select("k", "p.*")
    rows = reference.select((F.col(key).cast("string") if key in reference.columns else F.lit(None).cast("string")).alias("k"), *[F.col(m).cast("string").alias(f"r_{m}") for m in metrics]).join(ours, "k", "left")
    each = F.explode(F.array(*[F.struct(F.concat(F.lit(f"{label}["), F.coalesce("k", F.lit("")), F.lit(f"].{m}")).alias("metric"), F.col(f"r_{m}").alias("reference"), F.col(f"p_{m}").alias("result")) for m in metrics]))
    return compared(rows.select(each.alias("x")).select("x.*"), tolerance)


# Metrics that snapshots have, and what results call those that have another name.
MONTHLY = ("commit_count", "commits", "unique_authors", "total_productivity", "avg_score", "avg_weighted_score")
CALLED = {"commit_count": "commits", "avg_score": "avg_weighted_score", "count": "commit_count", "percentage": "pct_of_total"}


def compare_monthly(reference: DataFrame, result: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """By the first seven characters of the month; of several rows of a month the first."""
    both = [t.withColumn("month", F.substring(F.col("month").cast("string"), 1, 7)) for t in (reference, result)]
    return compare_by_key(*both, "month", MONTHLY, "monthly_trends", tolerance, names=CALLED, last=False)


#: By what authors are ranked: the first of these that both sides have, or else that a side has.
MEASURES = ("total_productivity", "commits", "total_lines_changed")


def _ranked_by(reference: DataFrame, result: DataFrame) -> tuple[str, str] | None:
    both = [(m, m) for m in MEASURES if m in reference.columns and m in result.columns]
    own = [next((m for m in MEASURES if m in t.columns), None) for t in (reference, result)]
    return both[0] if both else tuple(own) if all(own) else None


def compare_authors(reference: DataFrame, result: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """The ranking, then commits and productivity of each author of the reference, who is named by author_email or author; of several rows of an author the last.

    A side without any measure isn't ranked.
    """
    key = "author_email" if "author_email" in reference.columns else "author"
    found = compare_by_key(reference, result, key, ("commits", "total_productivity"), "author", tolerance, result_key="author_email")
    by = _ranked_by(reference, result)
    if not by or key not in reference.columns or "author_email" not in result.columns:
        return found
    sides = [t.select(F.col(k).alias("author_email"), F.col(m).cast("string").try_cast("double").alias("by")) for t, k, m in ((reference, key, by[0]), (result, "author_email", by[1]))]
    ranked = compare_ranking(*sides, "author_email", "by")
    none = F.lit(None)
    return ranked.select(F.lit("author_ranking").alias("metric"), none.cast("string").alias("reference"), none.cast("string").alias("result"), "status", none.cast("double").alias("delta")).unionByName(found)


def compare_categories(reference: DataFrame, result: DataFrame, tolerance: float = 0.01) -> DataFrame:
    return compare_by_key(reference, result, "category", ("count", "percentage", "commit_count", "pct_of_total"), "category", tolerance, names=CALLED)


COMPARERS = {"monthly_trends": compare_monthly, "author_productivity": compare_authors, "category_distribution": compare_categories}


def validate(snapshot: dict[str, DataFrame], results: dict[str, DataFrame], tolerance: float = 0.01) -> DataFrame | None:
    """All datasets that both have; None if there are none."""
    found = [COMPARERS[k](snapshot[k], results[k], tolerance) for k in COMPARERS if k in snapshot and results.get(k) is not None]
    return reduce(DataFrame.unionByName, found) if found else None


def verdict(results: DataFrame) -> tuple[str, int]:
    """The line of counts, and 1 if anything failed, else 0."""
    n = {r["status"]: r["n"] for r in summary(results).collect()}
    return f"Validation: {n.get('PASS', 0)} PASS, {n.get('OK', 0)} OK, {n.get('FAIL', 0)} FAIL", int("FAIL" in n)


def compare_ranking(reference: DataFrame, result: DataFrame, name: str, by: str) -> DataFrame:
    """Whether the first names by a measure are the same, in order: TOP, or as many as the shorter side has."""
    lists = []
    for side, t in (("reference", reference), ("result", result)):
        top = t.select(name, by).orderBy(F.desc(by), F.asc_nulls_last(name)).limit(TOP)
        listed = F.transform(F.sort_array(F.collect_list(F.struct((-F.col(by)).alias("o"), F.coalesce(name, F.lit("~")).alias("n")))), lambda x: x["n"])
        lists.append(top.agg(listed.alias(side)))
    both = lists[0].crossJoin(lists[1]).withColumn("n", F.least(F.size("reference"), F.size("result")))
    cut = {s: F.array_join(F.slice(s, 1, F.greatest("n", F.lit(1))), ",") for s in ("reference", "result")}
    return both.select(F.lit("ranking").alias("metric"), F.when(cut["reference"] == cut["result"], "PASS").otherwise("FAIL").alias("status"), F.col("n").cast("long").alias("n_compared"))


def summary(results: DataFrame) -> DataFrame:
    return results.groupBy("status").agg(F.count("*").alias("n"))


def all_passed(results: DataFrame) -> bool:
    return results.filter("status = 'FAIL'").isEmpty()


def save_snapshot(results: dict[str, DataFrame], period: tuple[str, str], generated_at: str, path: str) -> None:
    """Small results as one JSON file on the driver."""
    body = {"period": {"since": period[0], "until": period[1]}, "generated_at": generated_at}
    body |= {k: [r.asDict() for r in t.collect()] for k, t in results.items()}
    with open(path, "w", encoding="utf-8") as f:
        json.dump(body, f, indent=1, default=str)


def load_snapshot(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Datasets of a JSON snapshot, or of a CSV with a dataset column; empty cells are null."""
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            body = json.load(f)
        return {k: _rows(spark, v) for k, v in body.items() if isinstance(v, list) and v}
    if path.endswith(".csv"):
        rows = spark.read.option("header", True).option("inferSchema", True).csv(path)
        return {r[0]: rows.filter(F.col("dataset") == r[0]).drop("dataset") for r in rows.select("dataset").distinct().collect()}
    raise ValueError(f"a snapshot is .json or .csv, not {path}")


def period_of(path: str) -> tuple[str, str] | None:
    """The period that a JSON snapshot is of."""
    if not path.endswith(".json"):
        return None
    with open(path, encoding="utf-8") as f:
        found = json.load(f).get("period") or {}
    return (found["since"], found["until"]) if {"since", "until"} <= set(found) else None


def _rows(spark: SparkSession, rows: list[dict]) -> DataFrame:
    names = list(dict.fromkeys(k for r in rows for k in r))
    return spark.createDataFrame([tuple(None if r.get(n) is None else str(r[n]) for n in names) for r in rows], ", ".join(f"`{n}` string" for n in names))
