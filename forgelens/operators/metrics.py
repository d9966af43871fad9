"""The analytical queries, as functions of the tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from forgelens.functions.columns import days_between, month_of, pct_change, rounded


@dataclass(frozen=True)
class Filters:
    """since <= date < until; repositories by path (none: all); excluded e-mails, exactly as written."""

    since: str
    until: str
    repos: tuple[str, ...] = ()
    excluded: tuple[str, ...] = ()

    def dates(self, column: str, since: str | None = None, until: str | None = None) -> Column:
        start, end = (F.lit(x).cast("timestamp_ntz") for x in (since or self.since, until or self.until))
        return (F.col(column) >= start) & (F.col(column) < end)

    def others(self) -> Column:
        """Repositories and people of commits."""
        out = F.lit(True)
        if self.repos:
            out = F.col("project_path").isin(*self.repos)
        return out & ~F.col("author_email").isin(*self.excluded) if self.excluded else out

    def commits(self, commits: DataFrame) -> DataFrame:
        return commits.filter(self.dates("authored_date") & self.others())

    def merge_requests(self, requests: DataFrame) -> DataFrame:
        """Repositories by the last segment of their path."""
        where = self.dates("created_at")
        if self.repos:
            where &= F.col("project_name").isin(*[r.rsplit("/", 1)[-1] for r in self.repos])
        if self.excluded:
            where &= ~F.col("author_email").isin(*self.excluded)
        return requests.filter(where)


def has_scores(scores: DataFrame) -> bool:
    return not scores.isEmpty()


def _with_scores(commits: DataFrame, scores: DataFrame) -> DataFrame:
    return commits.join(scores.select("commit_sha", "total_productivity", "weighted_score", "overall_category"), "commit_sha", "left")


def _commits() -> Column:
    return F.countDistinct("commit_sha").alias("commits")


def _authors() -> Column:
    return F.countDistinct("author_email").alias("unique_authors")


def _lines() -> Column:
    return F.sum(F.col("additions") + F.col("deletions")).alias("total_lines_changed")


def _productivity() -> Column:
    return rounded(F.coalesce(F.sum("total_productivity"), F.lit(0.0)), 2).alias("total_productivity")


def _score() -> Column:
    return rounded(F.coalesce(F.avg("weighted_score"), F.lit(0.0)), 3).alias("avg_weighted_score")


def monthly_trends(commits: DataFrame, scores: DataFrame | None, filters: Filters) -> DataFrame:
    """By month; with scores productivity, else lines."""
    rows = filters.commits(commits)
    rows, last = (_with_scores(rows, scores), [_productivity(), _score()]) if scores is not None else (rows, [_lines()])
    return rows.groupBy(month_of(F.col("authored_date")).alias("month")).agg(_commits(), _authors(), *last).orderBy("month")


def compared(found: DataFrame, spans: tuple[str, str]) -> DataFrame:
    """A row for each of two periods, found or not, and one of changes in per cent."""
    names = [c for c in found.columns if c != "period"]
    periods = found.sparkSession.createDataFrame([(p,) for p in spans], "period string")
    never_null = [c for c in names if c != "total_lines_changed"]
    both = F.broadcast(periods).join(found, "period", "left").fillna(0, never_null).select("period", *[F.col(c).cast("double") for c in names])
    sides = both.groupBy().agg(*[F.max(F.when(F.col("period") == p, F.col(c))).alias(f"{p}_{c}") for p in spans for c in names])
    change = sides.select(F.lit("% change").alias("period"), *[pct_change(F.col(f"{spans[0]}_{c}"), F.col(f"{spans[1]}_{c}")).alias(c) for c in names])
    return both.unionByName(change)


def period_comparison(commits: DataFrame, scores: DataFrame | None, filters: Filters, baseline: tuple[str, str], comparison: tuple[str, str]) -> DataFrame:
    """A row a period, also an empty one, and a row of changes in per cent; one scan for both periods, which may overlap."""
    spans = {"baseline": baseline, "comparison": comparison}
    rows = commits.filter(filters.others())
    inside = F.array_compact(F.array(*[F.when(filters.dates("authored_date", *span), F.lit(p)) for p, span in spans.items()]))
    rows = rows.filter(filters.dates("authored_date", *baseline) | filters.dates("authored_date", *comparison)).withColumn("period", F.explode(inside))
    rows, last = (_with_scores(rows, scores), [_productivity(), _score()]) if scores is not None else (rows, [_lines()])
    days = F.countDistinct(F.col("authored_date").cast("date")).alias("active_days")
    found = rows.groupBy("period").agg(_commits(), _authors(), *last, days)
    return compared(found, tuple(spans))


def author_productivity(commits: DataFrame, scores: DataFrame | None, filters: Filters, limit: int = 20) -> DataFrame:
    """The most productive authors; ties by e-mail and name, categories' ties by name."""
    rows = filters.commits(commits)
    by_author = [F.asc_nulls_last("author_email"), F.asc_nulls_last("author_name")]
    if scores is None:
        return rows.groupBy("author_name", "author_email").agg(_commits(), _lines()).orderBy(F.desc_nulls_last("total_lines_changed"), *by_author).limit(limit)
    best = _with_scores(rows, scores).groupBy("author_name", "author_email").agg(_commits(), _productivity(), _score()).orderBy(F.desc("total_productivity"), *by_author).limit(limit)
    theirs = rows.join(F.broadcast(best.select("author_email").distinct()), "author_email", "left_semi")  # at most limit addresses
    found = theirs.join(scores.select("commit_sha", "overall_category"), "commit_sha").groupBy("author_email", "overall_category").agg(F.count("*").alias("n"))
    first = Window.partitionBy("author_email").orderBy(F.desc("n"), F.asc_nulls_last("overall_category"))
    top = found.withColumn("rn", F.row_number().over(first)).filter("rn = 1").select("author_email", "overall_category")
    with_top = best.join(top, "author_email", "left").withColumn("top_category", F.coalesce("overall_category", F.lit("-")))
    return with_top.select("author_name", "author_email", "commits", "total_productivity", "avg_weighted_score", "top_category").orderBy(F.desc("total_productivity"), *by_author)


def merge_velocity(requests: DataFrame, filters: Filters) -> DataFrame:
    days = days_between(F.col("created_at"), F.col("merged_at"))
    merged = F.col("state") == "merged"
    n, n_merged = F.count("*"), F.count_if(merged)
    return (
        filters.merge_requests(requests)
        .groupBy(month_of(F.col("created_at")).alias("month"))
        .agg(
            n.alias("total_mrs"), n_merged.alias("merged_count"), rounded(n_merged * F.lit(100.0) / n, 1).alias("merge_rate_pct"),
            rounded(F.avg(days), 2).alias("avg_days_to_merge"), F.count_if(merged & (days <= 7)).alias("merged_within_7d"), F.count_if(merged & (days <= 30)).alias("merged_within_30d"),
        )
        .orderBy("month")
    )


def category_distribution(commits: DataFrame, scores: DataFrame, filters: Filters) -> DataFrame:
    rows = filters.commits(commits).join(scores, "commit_sha").groupBy(F.col("overall_category").alias("category"))
    found = rows.agg(F.count("*").alias("commit_count"), rounded(F.avg("weighted_score"), 3).alias("avg_score"))
    total = found.agg(F.sum("commit_count").alias("total"))
    share = rounded(F.col("commit_count") * F.lit(100.0) / F.nullif(F.col("total"), F.lit(0)), 1).alias("pct_of_total")
    return found.crossJoin(F.broadcast(total)).select("category", "commit_count", share, "avg_score").orderBy(F.desc("commit_count"), F.asc_nulls_last("category"))


def _like_pairs(projects: DataFrame, names: DataFrame) -> DataFrame:
    """(project_id, project_name) where the id is LIKE "%" and the name: by equal endings, and for names with "_" by the ending's length, first and last character. Names with "%" or "\\", which no forge allows, are tried on each project."""
    name = F.col("project_name")
    ends = projects.select("project_id", F.explode(F.sequence(F.lit(1), F.length("project_id"))).alias("n")).withColumn("end", F.expr("right(project_id, n)")).filter("project_id <> ''")
    plain = ends.join(names.filter(~name.rlike(r"[%_\\]")), F.col("end") == name)
    edges = F.explode(F.array_distinct(F.array(*[F.concat(a, b) for a in (F.left("end", F.lit(1)), F.lit("_")) for b in (F.right("end", F.lit(1)), F.lit("_"))])))
    holes = names.filter(name.contains("_") & ~name.rlike(r"[%\\]")).select("project_name", F.length(name).alias("n"), F.concat(F.left(name, F.lit(1)), F.right(name, F.lit(1))).alias("edge"))
    open_ = ends.withColumn("edge", edges).join(holes, ["n", "edge"]).filter(F.expr("end LIKE project_name"))
    odd = projects.join(names.filter(name.rlike(r"[%\\]") | (name == "")), F.expr("project_id LIKE concat('%', project_name)"))
    return plain.select("project_id", "project_name").unionByName(open_.select("project_id", "project_name")).unionByName(odd.select("project_id", "project_name"))


def _held(links: DataFrame, merged: DataFrame, strict: bool) -> DataFrame:
    """commit_sha of links to merged requests. Every join is by number and project, so numbers that all projects have meet in no group."""
    if strict:
        by_id = links.join(merged.select("mr_iid", F.col("mr_project").alias("project_id")).distinct(), ["mr_iid", "project_id"], "left_semi")
        last = links.withColumn("project_name", F.element_at(F.split("project_id", "/"), -1))
        by_name = last.join(merged.select("mr_iid", "project_name").distinct(), ["mr_iid", "project_name"], "left_semi")
        return by_id.select("commit_sha").unionByName(by_name.select("commit_sha")).distinct()
    pairs = _like_pairs(links.select("project_id").distinct(), merged.select("project_name").distinct())
    named = merged.select("mr_iid", "project_name").distinct().join(pairs, "project_name").select("mr_iid", "project_id").distinct()
    return links.join(named, ["mr_iid", "project_id"], "left_semi").select("commit_sha").distinct()


def code_efficiency(commits: DataFrame, requests: DataFrame, links: DataFrame, filters: Filters, strict: bool = False) -> DataFrame:
    """Additions of commits that a merged request holds. Not strict: a project matches by LIKE on the end of its id; strict: by id, or the whole last segment."""
    merged = requests.filter("state = 'merged'").select("mr_iid", "project_name", F.col("project_id").alias("mr_project"))
    held = _held(links, merged, strict).withColumn("held", F.lit(True))
    rows = filters.commits(commits).select("commit_sha", "authored_date", "additions").join(held, "commit_sha", "left")
    all_, kept = F.sum("additions"), F.sum(F.when(F.col("held"), F.col("additions")).otherwise(0))
    share = rounded(kept * F.lit(100.0) / F.nullif(all_, F.lit(0)), 1)
    return rows.groupBy(month_of(F.col("authored_date")).alias("month")).agg(all_.alias("total_additions"), kept.alias("merged_additions"), share.alias("efficiency_pct")).orderBy("month")
