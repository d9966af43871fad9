"""Sums by day hold the answers of the commits themselves, also after days are made anew."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from forgelens.operators import metrics, rollup
from forgelens.sources.warehouse import Warehouse

COMMITS = "commit_sha string, project_path string, author_name string, author_email string, authored_date timestamp_ntz, additions int, deletions int"
SCORES = "commit_sha string, total_productivity double, weighted_score double, overall_category string"
FILTERS = metrics.Filters("2024-01-01", "2025-01-01", excluded=("e3",))
SPANS = (("2024-01-01", "2024-07-01"), ("2024-04-01", "2024-12-01"))


def odd_rows(seed, n=300):
    """Repeated commits, also of several days and people, and nulls in all columns."""
    r = random.Random(seed)
    maybe = lambda v: None if r.random() < 0.08 else v
    commits = [
        (maybe(f"s{r.randrange(n)}"), maybe(f"org/p{r.randrange(3)}"), maybe(f"n{r.randrange(5)}"), maybe(f"e{r.randrange(6)}"),
         maybe(dt.datetime(2023, 12, 1) + dt.timedelta(minutes=r.randrange(600_000))), maybe(r.randrange(50)), maybe(r.randrange(9)))
        for _ in range(n)
    ]
    scores = [(maybe(f"s{r.randrange(n)}"), maybe(r.randrange(64) / 16), maybe(r.randrange(64) / 64), maybe(r.choice("abc"))) for _ in range(n // 2)]
    return commits, scores


def same(a, b):
    assert a.columns == b.columns and sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


def check(table, commits, scores, filters=FILTERS):
    for s in (None, scores):
        same(rollup.monthly_trends(table, filters, s is not None), metrics.monthly_trends(commits, s, filters))
        same(rollup.period_comparison(table, filters, s is not None, *SPANS), metrics.period_comparison(commits, s, filters, *SPANS))
        same(rollup.author_productivity(table, filters, s is not None, 1000), metrics.author_productivity(commits, s, filters, 1000))
    same(rollup.category_distribution(table, filters), metrics.category_distribution(commits, scores, filters))


@pytest.mark.parametrize("seed", [1, 2])
def test_answers_are_those_of_the_commits(spark, seed):
    rows, scored = odd_rows(seed)
    commits, scores = spark.createDataFrame(rows, COMMITS).withColumn("clash", F.lit(1)), spark.createDataFrame(scored, SCORES).withColumn("clash", F.lit(2))
    table = rollup.activity(commits, scores, spread=2).persist()
    check(table, commits, scores)
    check(table, commits, scores, metrics.Filters("2024-02-01", "2024-11-15", repos=("org/p1",)))
    check(rollup.activity(commits.limit(0), scores.limit(0)), commits.limit(0), scores.limit(0))


def test_numbers_are_dense_and_stay(spark):
    first = rollup.numbered(spark.range(70_000).select(F.col("id").cast("string")), spread=1)
    assert tuple(first.agg(F.min("id"), F.max("id"), F.countDistinct("id")).first()) == (1, 70_000, 70_000)
    more = rollup.numbered(spark.range(69_000, 71_000).select(F.col("id").cast("string")), first, spread=1)
    assert tuple(more.agg(F.min("id"), F.max("id"), F.countDistinct("id"), F.countDistinct("value")).first()) == (1, 71_000, 71_000, 71_000)
    assert more.join(first, ["value", "id"]).count() == 70_000
    few = rollup.numbered(spark.range(5000).select(F.col("id").cast("string")), spread=3)
    assert few.select(F.bitmap_bucket_number("id")).distinct().count() == 3 and few.select("id").distinct().count() == 5000


def test_many_people_fill_several_bitmaps(spark):
    n = 80_000
    commits = spark.range(n).select(F.col("id").cast("string").alias("commit_sha"), F.lit("p").alias("project_path"), F.lit("n").alias("author_name"), F.concat(F.lit("e"), F.col("id") % 70_000).alias("author_email"),
                                    F.expr("timestamp_ntz'2024-03-01' + make_dt_interval(cast(id % 20 as int))").alias("authored_date"), F.lit(1).alias("additions"), F.lit(0).alias("deletions"))
    table = rollup.activity(commits, spark.createDataFrame([], SCORES), spread=2)
    [row] = rollup.monthly_trends(table, metrics.Filters("2024-01-01", "2025-01-01"), False).collect()
    assert (row["commits"], row["unique_authors"], row["total_lines_changed"]) == (n, 70_000, n)


def test_days_made_anew(spark, tmp_path):
    """New commits on some days, among them copies of commits that had been alone: the table is as one made of all."""
    store = Warehouse(spark, str(tmp_path / "w"))
    store.create_tables()
    rows, scored = odd_rows(3)
    first, later = rows[:200], rows[200:]
    store.insert("commits", spark.createDataFrame(first, COMMITS))
    store.insert("commit_scores", spark.createDataFrame(scored, SCORES))
    rollup.refresh(store)
    old = store.table("activity").select("author_email", "person", "again_sha", "again").distinct().collect()
    check(store.table("activity"), store.table("commits"), store.table("commit_scores"))
    store.insert("commits", spark.createDataFrame(later, COMMITS))
    rollup.refresh(store, spark.createDataFrame([(r[4].date(),) for r in later if r[4]] + [(dt.date(1999, 1, 1),)], "day date"))
    check(store.table("activity"), store.table("commits"), store.table("commit_scores"))
    new = store.table("activity").collect()
    assert len(new) == rollup.activity(store.table("commits"), store.table("commit_scores")).count()
    for value, number in (("author_email", "person"), ("again_sha", "again")):
        now = {r[value]: r[number] for r in new if r[number]}
        assert len(set(now.values())) == len(now) and all(now.get(r[value], r[number]) == r[number] for r in old if r[number])


def test_one_scan_with_pushed_days(spark, tmp_path):
    rows, scored = odd_rows(4)
    rollup.activity(spark.createDataFrame(rows, COMMITS), spark.createDataFrame(scored, SCORES)).write.parquet(str(tmp_path / "a"))
    plan = rollup.period_comparison(spark.read.parquet(str(tmp_path / "a")), FILTERS, True, *SPANS)._jdf.queryExecution().executedPlan().toString()
    trends = rollup.monthly_trends(spark.read.parquet(str(tmp_path / "a")), FILTERS, True)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and trends.count("FileScan") == 1 and "GreaterThanOrEqual(day,2024-01-01)" in trends
    assert "again_sha" not in trends.split("ReadSchema")[1]


def test_bounds_within_a_day(spark):
    table = rollup.activity(spark.createDataFrame([], COMMITS), spark.createDataFrame([], SCORES))
    with pytest.raises(ValueError, match="by day"):
        rollup.monthly_trends(table, metrics.Filters("2024-01-01", "2024-02-01T12:00:00"), True)
