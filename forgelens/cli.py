"""python -m forgelens.cli [query|extract|score|snapshot|validate|report|merge] --config FILE --query NAME --since DAY --until DAY"""

from __future__ import annotations

import argparse
import datetime as dt
import sys
from collections.abc import Iterable
from dataclasses import replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forgelens import config, report
from forgelens.functions.columns import pseudonym
from forgelens.operators import identity, metrics, rollup, scoring, validation
from forgelens.sources.extract import Extraction
from forgelens.sources.files import IdentityFile, Progress, key_of
from forgelens.sources.warehouse import Warehouse, open_warehouse

NAMES = ("monthly_trends", "period_comparison", "author_productivity", "merge_velocity", "category_distribution", "code_efficiency")


def answer(store: Warehouse, name: str, filters: metrics.Filters, periods: tuple[tuple[str, str], tuple[str, str]] | None = None, limit: int = 20, scored: bool | None = None) -> DataFrame | None:
    """One of the six queries; scored: with scores (None: if there are any). None where it needs scores and there are none."""
    commits, scores = store.table("commits"), store.table("commit_scores")
    scores = scores if (metrics.has_scores(scores) if scored is None else scored) else None
    if name == "monthly_trends":
        return metrics.monthly_trends(commits, scores, filters)
    if name == "period_comparison":
        return metrics.period_comparison(commits, scores, filters, *periods)
    if name == "author_productivity":
        return metrics.author_productivity(commits, scores, filters, limit)
    if name == "merge_velocity":
        return metrics.merge_velocity(store.table("merge_requests"), filters)
    if name == "category_distribution":
        return metrics.category_distribution(commits, scores, filters) if scores is not None else None
    return metrics.code_efficiency(commits, store.table("merge_requests"), store.table("mr_commits"), filters)


def _options(args: list[str] | None) -> argparse.Namespace:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("command", nargs="?", choices=["query", "extract", "score", "snapshot", "validate", "report", "merge", "rollup"], default="query")
    p.add_argument("--config", required=True)
    p.add_argument("--query", choices=[*NAMES, "all"], default="all")
    p.add_argument("--since")
    p.add_argument("--until")
    p.add_argument("--format", choices=list(report.FORMATS), default="table")
    p.add_argument("--limit", type=int, default=20)
    p.add_argument("--file", help="snapshot or report to write, or snapshot to compare with")
    p.add_argument("--tolerance", type=float, default=0.01)
    p.add_argument("--canonical", help="merge: the address that stays")
    p.add_argument("--alias", action="append", default=[], help="merge: an address that is the same person's")
    p.add_argument("--transport", default="", help="extract: module:function instead of the network")
    p.add_argument("--scorer", help="score: module:function of a prompt that returns a reply, instead of rules")
    p.add_argument("--tasks", type=int, default=8, help="score: tasks that call the scorer")
    p.add_argument("--in-flight", type=int, default=10, help="score: calls of a task at a time")
    p.add_argument("--calls-a-second", type=int, default=0, help="score: of all tasks together; 0 for no bound")
    p.add_argument("--from-rollup", action="store_true", help="query: questions about commits from the sums by day that the command rollup has made")
    p.add_argument("--full", action="store_true", help="extract: everything, not only what is newer than the last run's")
    for side in ("baseline", "comparison"):
        p.add_argument(f"--{side}-start")
        p.add_argument(f"--{side}-end")
    return p.parse_args(args)


def beside(path: str, name: str) -> Path:
    """A file of state next to the settings."""
    return Path(path).resolve().parent / name


def main(args: list[str] | None = None) -> int:
    a = _options(args)
    c = config.load(a.config)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    store = open_warehouse(spark, replace(c, readonly=c.readonly or a.command not in ("extract", "score", "merge", "rollup")))
    since, until = a.since or "1970-01-01", a.until or "2100-01-01"
    filters = metrics.Filters(since, until, c.repos, c.excluded)
    if a.command == "extract":
        store.create_tables()
        progress = Progress(beside(a.config, "progress"))
        added = Extraction(spark, store, c, a.since, a.until, a.transport, full=a.full).run(progress, IdentityFile(beside(a.config, "people.json")))
        print(", ".join(f"{t}: {n}" for t, n in added.items()))
        unfinished = [r for r in c.repos if progress.exists(r)]
        if unfinished:
            print(f"unfinished, to be asked again: {', '.join(unfinished)}")
            return 1
    elif a.command == "score":
        n = scoring.score_commits(store, a.scorer, c.excluded, tasks=a.tasks, in_flight=a.in_flight, calls_a_second=a.calls_a_second)
        print(f"scored by {a.scorer or 'rule'}: {n}")
    elif a.command == "rollup":
        rollup.refresh(store)
        print(f"rows of activity: {store.count('activity')}")
    elif a.command == "merge":
        c = config.add_merges(a.config, a.canonical, a.alias)
        print(f"values changed: {merge_people(store, c, IdentityFile(beside(a.config, 'people.json')))}")
    elif a.command == "snapshot":
        validation.save_snapshot(_results(store, filters, validation.COMPARERS), (since, until), dt.datetime.now(dt.UTC).isoformat(), a.file)
    elif a.command == "validate":
        snapshot = validation.load_snapshot(spark, a.file)
        period = validation.period_of(a.file) or (since, until)
        filters = replace(filters, since=a.since or period[0], until=a.until or period[1])
        found = validation.validate(snapshot, _results(store, filters, validation.COMPARERS), a.tolerance)
        if found is None:
            print("_No comparisons performed._")
            return 0
        line, failed = validation.verdict(found)
        print(report.markdown(found) + f"\n{line}")
        return failed
    elif a.command == "report":
        text = report.report("Engineering activity", (since, until), _results(store, filters, NAMES, _periods(a)))
        if a.file:
            Path(a.file).write_text(text, encoding="utf-8")
        else:
            print(text)
    else:
        if a.query == "period_comparison" and not _periods(a):
            raise SystemExit("period_comparison needs both periods")
        for name in [n for n in NAMES if n != "period_comparison"] if a.query == "all" else [a.query]:
            result = rollup.answer(store, name, filters, _periods(a), a.limit, metrics.has_scores(store.table("commit_scores"))) if a.from_rollup else None
            result = answer(store, name, filters, _periods(a), a.limit) if result is None else result
            print(f"## {name}\n" + (report.FORMATS[a.format](result) if result is not None else "no scores"))
    return 0


def _periods(a: argparse.Namespace) -> tuple[tuple[str, str], tuple[str, str]] | None:
    days = (a.baseline_start, a.baseline_end, a.comparison_start, a.comparison_end)
    return ((days[0], days[1]), (days[2], days[3])) if all(days) else None


def _results(store: Warehouse, filters: metrics.Filters, names: Iterable[str], periods: tuple[tuple[str, str], tuple[str, str]] | None = None) -> dict[str, DataFrame]:
    """Those of the queries that can be answered."""
    found = {n: answer(store, n, filters, periods) for n in names if n != "period_comparison" or periods}
    return {n: t for n, t in found.items() if t is not None}


def merge_people(store: Warehouse, c: config.Config, people: IdentityFile) -> int:
    """Rewrites the pseudonyms of merged addresses that the file of people knows; the number of values that changed."""
    known = people.load()
    by_email = {(p.get("email") or "").strip().lower(): h for h, p in known.items()}
    names = [(by_email[a], to) for a, to in c.aliases.items() if a in by_email]
    if not (names and c.key):
        return 0
    rows = store.spark.createDataFrame(names, "old string, canonical string").withColumn("new", pseudonym(F.col("canonical"), key_of(c.key)))
    found = [r for r in rows.collect() if r["old"] != r["new"]]
    if not found:
        return 0
    merges = store.spark.createDataFrame([(r["old"], r["new"]) for r in found], "old string, new string")
    canonical = {r["new"]: (known.get(by_email.get(r["canonical"], ""), known[r["old"]]).get("name"), r["canonical"]) for r in found}
    return identity.apply_merges(store, merges, people, canonical)


if __name__ == "__main__":
    sys.exit(main())
