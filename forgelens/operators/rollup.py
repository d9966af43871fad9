"""Daily activity: one small table from which the questions about commits are answered without commits.

A row is what one author did in one project on one day: sums, and members of exact sets. People and
commits that occur more than once have numbers, so that a set of them is a bitmap: tasks merge bitmaps
before anything is shuffled, and a distinct count is a count of bits. Commits that occur once are only
counted. Bounds of periods are days, as days are what the table holds.

Null dates belong to no day and are left out; null people and null commits are in no set, as in
COUNT(DISTINCT); null names, projects and categories are values like others.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from forgelens.functions.columns import month_of, rounded
from forgelens.operators.metrics import Filters, compared
from forgelens.schemas import STATE
from forgelens.sources.warehouse import Warehouse

#: Numbers are dealt by this many tasks; a bitmap holds 32,768 of them.
SPREAD, BITS = 16, 32_768
SUMS = ("commits", "lines", "additions", "scored", "productivity", "score", "score_n")


def numbered(values: DataFrame, known: DataFrame | None = None, spread: int = SPREAD) -> DataFrame:
    """(value, id) of distinct values that aren't null; those of known keep their ids. Each hash class fills bitmaps of its own, so classes are numbered side by side and ids stay dense."""
    values = values.toDF("value").filter("value is not null").distinct()
    if known is not None:
        values = values.join(known.select("value"), "value", "left_anti")
    new = values.withColumn("class", F.expr(f"pmod(xxhash64(value), {spread})")).withColumn("rn", F.row_number().over(Window.partitionBy("class").orderBy("value")) - 1)
    if known is not None:  # a class goes on where it stood
        place = known.select(F.expr(f"pmod((id - 1) div {BITS}, {spread})").alias("class"), F.expr(f"((id - 1) div {BITS * spread}) * {BITS} + pmod(id - 1, {BITS})").alias("rn"))
        new = new.join(F.broadcast(place.groupBy("class").agg((F.max("rn") + 1).alias("base"))), "class", "left").withColumn("rn", F.col("rn") + F.coalesce("base", F.lit(0)))
    new = new.select("value", F.expr(f"(class + {spread} * (rn div {BITS})) * {BITS} + rn % {BITS} + 1").cast("long").alias("id"))
    return new if known is None else known.select("value", "id").unionByName(new)


def activity(commits: DataFrame, scores: DataFrame, known: DataFrame | None = None, days: DataFrame | None = None, spread: int = SPREAD) -> DataFrame:
    """The table, or its part of some days (a column day). A commit's own sums stand in rows without scores, its scores' in rows of their category, so neither multiplies the other. known: an activity whose numbers stay."""
    numbers = (lambda value, id_: None) if known is None else lambda value, id_: known.filter(f"{id_} is not null").groupBy(F.col(value).alias("value")).agg(F.min(id_).alias("id"))
    many = commits.groupBy("commit_sha").agg(F.count("*").alias("n")).filter("n > 1 and commit_sha is not null").select("commit_sha")
    rows = commits.filter("authored_date is not null").select("commit_sha", F.col("authored_date").cast("date").alias("day"), "project_path", "author_name", "author_email", "additions", "deletions")
    if days is not None:
        rows = rows.join(days.select("day").distinct(), "day", "left_semi")
    again = numbered(many, numbers("again_sha", "again"), spread).withColumnsRenamed({"value": "commit_sha", "id": "again"})
    person = numbered(rows.select("author_email"), numbers("author_email", "person"), spread).withColumnsRenamed({"value": "author_email", "id": "person"})
    rows = rows.join(again, "commit_sha", "left").withColumn("again_sha", F.when(F.col("again").isNotNull(), F.col("commit_sha")))
    keys = ("day", "project_path", "author_name", "author_email", "again_sha", "again")
    own = rows.groupBy(*keys).agg(
        F.count(F.when(F.col("again").isNull(), F.col("commit_sha"))).alias("commits"), F.sum(F.col("additions") + F.col("deletions")).alias("lines"), F.sum("additions").alias("additions")
    )
    theirs = rows.join(scores.select("commit_sha", "total_productivity", "weighted_score", "overall_category"), "commit_sha").groupBy(*keys, F.col("overall_category").alias("category"))
    theirs = theirs.agg(F.count("*").alias("scored"), F.sum("total_productivity").alias("productivity"), F.sum("weighted_score").alias("score"), F.count("weighted_score").alias("score_n"))
    both = own.unionByName(theirs, allowMissingColumns=True).join(person, "author_email", "left")
    return both.select([F.col(f.name).cast(f.dataType) for f in STATE["activity"]])


def _within(since: str, until: str) -> Column:
    """since <= day < until."""
    bounds = [dt.datetime.fromisoformat(day) for day in (since, until)]
    for day in bounds:
        if day.time() != dt.time():
            raise ValueError(f"activity is kept by day; {day} is within one")
    return (F.col("day") >= F.lit(bounds[0].date())) & (F.col("day") < F.lit(bounds[1].date()))


def _rows(table: DataFrame, filters: Filters) -> DataFrame:
    return table.filter(_within(filters.since, filters.until) & filters.others())


def summed(rows: DataFrame, by: list[str], sets: tuple[str, ...] = ("again", "person")) -> DataFrame:
    """Sums by columns of few values, and n_<set> for each set's distinct members: bitmaps are merged by (by, set, bucket), then their bits counted."""
    number = {"again": F.col("again"), "person": F.col("person"), "day": F.unix_date("day").cast("long")}
    member = lambda i, name: F.when(number[name].isNotNull(), F.struct(F.lit(i).alias("kind"), F.bitmap_bucket_number(number[name]).alias("bucket"), F.bitmap_bit_position(number[name]).alias("bit")))
    itself = F.struct(F.lit(0).alias("kind"), F.lit(None).cast("long").alias("bucket"), F.lit(None).cast("long").alias("bit"))
    members = rows.select(*by, *SUMS, F.explode(F.array_compact(F.array(itself, *[member(i, s) for i, s in enumerate(sets, 1)]))).alias("m"))
    once = [F.sum(F.when(F.col("m.kind") == 0, F.col(c))).alias(c) for c in SUMS]  # a row's sums count once, whatever sets it has members in
    bitmaps = members.groupBy(*by, F.col("m.kind").alias("kind"), F.col("m.bucket").alias("bucket")).agg(*once, F.bitmap_construct_agg("m.bit").alias("bits"))
    counts = [F.coalesce(F.sum(F.when(F.col("kind") == i, F.bitmap_count("bits"))), F.lit(0)).alias(f"n_{s}") for i, s in enumerate(sets, 1)]
    return bitmaps.groupBy(*by).agg(*[F.sum(c).alias(c) for c in SUMS], *counts)


def _commits() -> Column:
    return (F.coalesce("commits", F.lit(0)) + F.col("n_again")).alias("commits")


def _last(scored: bool) -> list[Column]:
    if not scored:
        return [F.col("lines").alias("total_lines_changed")]
    mean = F.try_divide(F.col("score"), F.coalesce("score_n", F.lit(0)))
    return [rounded(F.coalesce("productivity", F.lit(0.0)), 2).alias("total_productivity"), rounded(F.coalesce(mean, F.lit(0.0)), 3).alias("avg_weighted_score")]


def monthly_trends(table: DataFrame, filters: Filters, scored: bool) -> DataFrame:
    found = summed(_rows(table, filters).withColumn("month", month_of(F.col("day").cast("timestamp_ntz"))), ["month"])
    return found.select("month", _commits(), F.col("n_person").alias("unique_authors"), *_last(scored)).orderBy("month")


def period_comparison(table: DataFrame, filters: Filters, scored: bool, baseline: tuple[str, str], comparison: tuple[str, str]) -> DataFrame:
    spans = {"baseline": baseline, "comparison": comparison}
    within = {p: _within(*span) for p, span in spans.items()}
    inside = F.array_compact(F.array(*[F.when(w, F.lit(p)) for p, w in within.items()]))
    rows = table.filter(filters.others() & (within["baseline"] | within["comparison"])).withColumn("period", F.explode(inside))
    found = summed(rows, ["period"], ("again", "person", "day"))
    return compared(found.select("period", _commits(), F.col("n_person").alias("unique_authors"), *_last(scored), F.col("n_day").alias("active_days")), tuple(spans))


def author_productivity(table: DataFrame, filters: Filters, scored: bool, limit: int = 20) -> DataFrame:
    """The most productive authors; ties by e-mail and name, categories' ties by name."""
    rows = _rows(table, filters)
    sums = [F.sum(c).alias(c) for c in SUMS]  # groups are many here, so their sets are no bitmaps
    found = rows.groupBy("author_name", "author_email").agg(*sums, F.countDistinct("again").alias("n_again")).select("author_name", "author_email", _commits(), *_last(scored))
    by_author = [F.asc_nulls_last("author_email"), F.asc_nulls_last("author_name")]
    if not scored:
        return found.orderBy(F.desc_nulls_last("total_lines_changed"), *by_author).limit(limit)
    best = found.orderBy(F.desc("total_productivity"), *by_author).limit(limit)
    counts = rows.filter("scored > 0 and author_email is not null").groupBy("author_email", "category").agg(F.sum("scored").alias("n"))
    order = F.struct((-F.col("n")).alias("n"), F.col("category").isNull().alias("none"), "category")
    top = counts.groupBy("author_email").agg(F.min(order).alias("first")).select("author_email", "first.category")
    named = best.join(top, "author_email", "left").withColumn("top_category", F.coalesce("category", F.lit("-")))
    return named.select("author_name", "author_email", "commits", "total_productivity", "avg_weighted_score", "top_category").orderBy(F.desc("total_productivity"), *by_author)


def category_distribution(table: DataFrame, filters: Filters) -> DataFrame:
    found = _rows(table, filters).filter("scored > 0").groupBy("category").agg(F.sum("scored").alias("commit_count"), rounded(F.try_divide(F.sum("score"), F.sum("score_n")), 3).alias("avg_score"))
    total = found.agg(F.sum("commit_count").alias("total"))  # a row; categories are few
    share = rounded(F.col("commit_count") * F.lit(100.0) / F.col("total"), 1).alias("pct_of_total")
    return found.crossJoin(F.broadcast(total)).select("category", "commit_count", share, "avg_score").orderBy(F.desc("commit_count"), F.asc_nulls_last("category"))


def refresh(store: Warehouse, changed: DataFrame | None = None) -> None:
    """Makes the warehouse's activity anew for the days on which commits or scores have changed (a column day), or for all. Days that hold another copy of a changed day's commit are made again with it, as a commit that was alone may be so no more; people and repeated commits keep their numbers."""
    store.create_tables()
    commits, scores, old = store.table("commits"), store.table("commit_scores"), store.table("activity")
    if changed is None:
        store.replace("activity", activity(commits, scores))
        return
    keys = commits.select("commit_sha", F.col("authored_date").cast("date").alias("day"))
    changed = changed.select("day").distinct()
    touched = keys.join(changed, "day", "left_semi").select("commit_sha").distinct()
    days = keys.join(touched, "commit_sha", "left_semi").select("day").unionByName(changed).distinct()
    store.replace("activity", old.join(days, "day", "left_anti").select(old.columns).unionByName(activity(commits, scores, old, days)))


def answer(store: Warehouse, name: str, filters: Filters, periods: tuple[tuple[str, str], tuple[str, str]] | None = None, limit: int = 20, scored: bool = True) -> DataFrame | None:
    """One of the questions about commits from the warehouse's activity; None for others."""
    table = store.table("activity")
    if name == "monthly_trends":
        return monthly_trends(table, filters, scored)
    if name == "period_comparison":
        return period_comparison(table, filters, scored, *periods)
    if name == "author_productivity":
        return author_productivity(table, filters, scored, limit)
    return category_distribution(table, filters) if name == "category_distribution" and scored else None
