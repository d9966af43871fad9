"""Warm times of the headline queries over written tables, and DuckDB's of the same SQL over the same files: one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 3).
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

import duckdb
from pyspark.sql import SparkSession

from forgelens.plans import catalog, derive

HEADLINE = [
    "monthly_trends_scored", "monthly_trends_raw", "period_comparison_scored", "period_comparison_raw", "author_productivity_scored", "author_productivity_raw",
    "merge_velocity", "category_distribution", "code_efficiency", "code_efficiency_strict", "cross_branch_dedup", "incremental_anti_join", "commits_missing_diffs", "anonymized_commits",
    "duplicate_identities", "retroactive_merge", "auto_score", "commit_productivity", "validate_monthly",
    "rollup_monthly_trends_scored", "rollup_period_comparison_scored", "rollup_period_comparison_raw", "rollup_author_productivity_scored", "rollup_category_distribution",
]
TABLES = ("commits", "commit_scores", "merge_requests", "mr_commits", "diffs", "developers", "branches", "activity")


def main() -> None:
    sf, cpus, runs = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), int(os.environ.get("BENCH_CPUS", "8")), int(os.environ.get("BENCH_RUNS", "3"))
    work = tempfile.mkdtemp(prefix="spark-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", str(cpus)).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.local.dir", work).config("spark.checkpoint.dir", f"file://{work}/shared").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    for name in TABLES:  # made once: what is timed are the queries, not the making of their tables
        path = f"{work}/tables/{name}"
        getattr(derive, name)(spark, sf).write.parquet(path)
        setattr(derive, name, lambda session, _, path=path: session.read.parquet(path))
    db = duckdb.connect(config={"threads": cpus})
    db.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{work}/tables/{name}/*.parquet'")

    def median(run) -> float:
        times = []
        for i in range(runs + 1):
            start = time.perf_counter()
            run()
            if i:  # the first compiles
                times.append(time.perf_counter() - start)
        return round(statistics.median(times), 3)

    took = {name: median(lambda name=name: catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()) for name in HEADLINE}
    other = {name: median(lambda name=name: db.execute(catalog.OVER_TABLES[name]).fetchall()) for name in HEADLINE}
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/")), "duckdb_total": round(sum(other.values()), 3), "duckdb": other}))
    spark.stop()


if __name__ == "__main__":
    main()
