"""The six tables, and inputs of other operators, made from the star schema that tests and benchmarks have.

The arithmetic is deterministic, scores are multiples of powers of two, and SQL below says the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forgelens.operators import rollup

def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _seconds(ts: str, n: str) -> Column:
    return F.expr(f"{ts} + make_dt_interval(0, 0, 0, {n})")


SHA = "lpad(cast(o_orderkey as string), 12, '0')"


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").cast("int").alias("a"), F.sum("l_linenumber").cast("int").alias("d"))
    rows = _read(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    name = F.expr("concat('dev', o_custkey % 40)")
    rows = rows.select(
        F.expr(SHA).alias("commit_sha"), F.expr("concat('org/repo_', o_custkey % 5)").alias("project_id"), F.expr("concat('repo_', o_custkey % 5)").alias("project_name"),
        F.expr("concat('org/repo_', o_custkey % 5)").alias("project_path"), name.alias("author_name"), F.when(F.expr("o_custkey % 40 <> 7"), F.concat(name, F.lit("@corp.example"))).alias("author_email"),
        _seconds("o_orderdate", "(37 * o_orderkey) % 86400").alias("authored_date"), F.coalesce("a", F.lit(0)).alias("additions"), F.coalesce("d", F.lit(0)).alias("deletions"), "o_orderkey",
    )
    return rows.withColumn("committed_date", _seconds("authored_date", "o_orderkey % 3600")).drop("o_orderkey")


def commit_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.round(F.col("l_discount") * 100).cast("bigint")
    lines = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg((F.sum(q * F.col("l_quantity").cast("bigint")) / 16).alias("total_productivity"), (F.sum(q) / 64).alias("weighted_score"))
    category = F.expr("CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'bugfix' WHEN '2' THEN 'feature' WHEN '3' THEN 'refactor' WHEN '5' THEN 'docs' END")
    rows = _read(spark, sf_dir, "orders").filter("o_orderkey % 4 <> 0").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.select(F.expr(SHA).alias("commit_sha"), "total_productivity", "weighted_score", category.alias("overall_category"))


def merge_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders").select(
        F.expr("cast(o_orderkey as string)").alias("mr_id"), F.expr("cast(o_orderkey div 3 as string)").alias("mr_iid"), F.expr("concat('org/repo_', o_custkey % 5)").alias("project_id"),
        F.expr("concat('repo_', o_custkey % 5)").alias("project_name"), F.expr("concat('dev', o_custkey % 40, '@corp.example')").alias("author_email"),
        F.expr("CASE o_orderstatus WHEN 'F' THEN 'merged' WHEN 'O' THEN 'opened' ELSE 'closed' END").alias("state"), F.col("o_orderdate").alias("created_at"),
        F.expr("CASE WHEN o_orderstatus = 'F' THEN o_orderdate + make_dt_interval(cast((7 * o_orderkey) % 45 as int)) END").alias("merged_at"),
    )


def mr_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "orders").filter("o_orderkey % 5 <> 1")
    return rows.select(F.expr("cast(o_orderkey as string)").alias("mr_id"), F.expr("cast(o_orderkey div 3 as string)").alias("mr_iid"), F.expr("concat('org/repo_', o_custkey % 5)").alias("project_id"), F.expr(SHA).alias("commit_sha"))


def diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.sum("l_quantity").cast("int").alias("additions"), F.sum("l_linenumber").cast("int").alias("deletions"))
    rows = lines.join(_read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    ext = F.expr("element_at(array('py', 'js', 'md', 'json', 'lock', 'map', 'yml', 'css'), cast(l_partkey % 8 as int) + 1)")
    folder = F.expr("CASE l_partkey % 8 WHEN 3 THEN 'src/' WHEN 4 THEN 'dist/' ELSE concat('src/', lower(p_type), '/') END")
    path = F.concat(folder, F.translate("p_name", " ", "_"), F.lit("_"), F.col("l_partkey").cast("string"), F.lit("."), ext)
    return rows.select(F.expr(SHA.replace("o_orderkey", "l_orderkey")).alias("commit_sha"), path.alias("file_path"), F.expr("CASE WHEN l_partkey % 8 = 3 THEN additions * 10 ELSE additions END").alias("additions"), "deletions")


def developers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ord, name and e-mail, with bots, generic names, padding and pairs of one person."""
    name = """CASE c_custkey % 11 WHEN 0 THEN 'renovate[bot]' WHEN 1 THEN 'GitLab CI' WHEN 2 THEN concat('Dev.', c_custkey div 3) WHEN 3 THEN concat('dev-', c_custkey div 3) WHEN 4 THEN 'Admin'
              WHEN 5 THEN concat('  Dev ', c_custkey div 3, ' ') ELSE concat('Dev ', c_custkey div 3) END"""
    email = """CASE c_custkey % 13 WHEN 0 THEN concat(c_custkey, '+x@users.noreply.github.com') WHEN 1 THEN NULL WHEN 2 THEN concat('talbot@corp', c_custkey, '.example') WHEN 3 THEN concat('no-at-', c_custkey)
               ELSE concat('user', c_custkey div 2, '@corp', c_custkey % 3, '.example') END"""
    return _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ord"), F.expr(name).alias("name"), F.expr(email).alias("email"))


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_path and a diff text for each part."""
    text = "concat('--- a', chr(10), '+++ b', chr(10), repeat(concat('+ x', chr(10)), cast(p_size % 7 as int)), ' same', chr(10), repeat(concat('- y', chr(10)), cast(p_size % 5 as int)), '@@ end')"
    return _read(spark, sf_dir, "part").select(F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("file_path"), F.expr(text).alias("diff"))


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's reply for each order: plain, fenced, amid other text, or none that can be read."""
    body = """concat('{"files": [{"path": "a.py", "score": 0.', o_orderkey % 9 + 1, ', "category": "', CASE o_orderkey % 3 WHEN 0 THEN 'feature' WHEN 1 THEN 'magic' ELSE 'test' END, '"}], "overall_category": "feature"}')"""
    reply = f"""CASE o_orderkey % 4 WHEN 0 THEN {body} WHEN 1 THEN concat('```json', chr(10), {body}, chr(10), '```') WHEN 2 THEN concat('Here it is: ', {body}, ' Done.') ELSE 'no reply' END"""
    return _read(spark, sf_dir, "orders").select(F.expr(SHA).alias("commit_sha"), F.expr(reply).alias("reply"))


def branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits as several branches list them: main (0), and each third on a branch listed before it or after."""
    orders = _read(spark, sf_dir, "orders")
    main = orders.select(F.expr(SHA).alias("commit_sha"), F.lit("main").alias("branch_name"), F.lit(1).alias("branch_ord"), F.col("o_orderkey").alias("pos"))
    other = orders.filter("o_orderkey % 3 = 0").select(F.expr(SHA).alias("commit_sha"), F.expr("concat('b', o_orderkey % 2)").alias("branch_name"), F.expr("cast((o_orderkey % 2) * 2 as int)").alias("branch_ord"), F.col("o_orderkey").alias("pos"))
    return main.unionByName(other)


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A merge request's answer for each order, in which some fields have changed their type."""
    parts = ["'{\"id\": '", "CASE o_orderkey % 5 WHEN 0 THEN '\"x9\"' WHEN 1 THEN '{\"v\": 1}' WHEN 2 THEN '\"17\"' ELSE cast(o_orderkey as string) END", "', \"title\": '", "CASE o_orderkey % 3 WHEN 0 THEN '[\"t\"]' WHEN 1 THEN '5' ELSE '\"t\"' END",
             "', \"author\": '", "CASE o_orderkey % 7 WHEN 0 THEN '\"ann\"' WHEN 1 THEN 'null' ELSE '{\"name\": \"n\"}' END", "', \"commits\": [{\"id\": '", "CASE o_orderkey % 4 WHEN 0 THEN 'true' ELSE '\"s\"' END", "CASE o_orderkey % 11 WHEN 0 THEN '}' ELSE '}]}' END"]
    return _read(spark, sf_dir, "orders").select(F.expr(SHA).alias("commit_sha"), F.expr(f"concat({', '.join(parts)})").alias("body"))


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums by day, person and project."""
    return rollup.activity(commits(spark, sf_dir), commit_scores(spark, sf_dir))


# The same in SQL, as common table expressions.
SQL = {
    "commits": """commits AS (SELECT lpad(o_orderkey::VARCHAR, 12, '0') AS commit_sha, 'org/repo_' || (o_custkey % 5) AS project_id, 'repo_' || (o_custkey % 5) AS project_name,
      'org/repo_' || (o_custkey % 5) AS project_path, 'dev' || (o_custkey % 40) AS author_name, CASE WHEN o_custkey % 40 <> 7 THEN 'dev' || (o_custkey % 40) || '@corp.example' END AS author_email,
      o_orderdate + to_seconds((37 * o_orderkey) % 86400) AS authored_date, o_orderdate + to_seconds((37 * o_orderkey) % 86400 + o_orderkey % 3600) AS committed_date,
      coalesce(a, 0) AS additions, coalesce(d, 0) AS deletions FROM orders LEFT JOIN
      (SELECT l_orderkey, sum(l_quantity)::INTEGER AS a, sum(l_linenumber)::INTEGER AS d FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey)""",
    "commit_scores": """commit_scores AS (SELECT lpad(o_orderkey::VARCHAR, 12, '0') AS commit_sha, tp AS total_productivity, ws AS weighted_score,
      CASE left(o_orderpriority, 1) WHEN '1' THEN 'bugfix' WHEN '2' THEN 'feature' WHEN '3' THEN 'refactor' WHEN '5' THEN 'docs' END AS overall_category FROM orders JOIN
      (SELECT l_orderkey, sum(round(l_discount * 100)::BIGINT * l_quantity::BIGINT)::DOUBLE / 16 AS tp, sum(round(l_discount * 100)::BIGINT)::DOUBLE / 64 AS ws FROM lineitem GROUP BY 1)
      ON o_orderkey = l_orderkey WHERE o_orderkey % 4 <> 0)""",
    "merge_requests": """merge_requests AS (SELECT o_orderkey::VARCHAR AS mr_id, (o_orderkey // 3)::VARCHAR AS mr_iid, 'org/repo_' || (o_custkey % 5) AS project_id, 'repo_' || (o_custkey % 5) AS project_name,
      'dev' || (o_custkey % 40) || '@corp.example' AS author_email, CASE o_orderstatus WHEN 'F' THEN 'merged' WHEN 'O' THEN 'opened' ELSE 'closed' END AS state, o_orderdate AS created_at,
      CASE WHEN o_orderstatus = 'F' THEN o_orderdate + to_days(((7 * o_orderkey) % 45)::INTEGER) END AS merged_at FROM orders)""",
    "mr_commits": """mr_commits AS (SELECT o_orderkey::VARCHAR AS mr_id, (o_orderkey // 3)::VARCHAR AS mr_iid, 'org/repo_' || (o_custkey % 5) AS project_id, lpad(o_orderkey::VARCHAR, 12, '0') AS commit_sha
      FROM orders WHERE o_orderkey % 5 <> 1)""",
    "diffs": """diffs AS (SELECT lpad(l_orderkey::VARCHAR, 12, '0') AS commit_sha, CASE l_partkey % 8 WHEN 3 THEN 'src/' WHEN 4 THEN 'dist/' ELSE 'src/' || lower(p_type) || '/' END || replace(p_name, ' ', '_') || '_' || l_partkey
      || '.' || ['py', 'js', 'md', 'json', 'lock', 'map', 'yml', 'css'][(l_partkey % 8 + 1)::INTEGER] AS file_path, CASE WHEN l_partkey % 8 = 3 THEN a * 10 ELSE a END AS additions, d AS deletions
      FROM (SELECT l_orderkey, l_partkey, sum(l_quantity)::INTEGER AS a, sum(l_linenumber)::INTEGER AS d FROM lineitem GROUP BY 1, 2) JOIN part ON l_partkey = p_partkey)""",
    "developers": """developers AS (SELECT c_custkey AS ord, CASE c_custkey % 11 WHEN 0 THEN 'renovate[bot]' WHEN 1 THEN 'GitLab CI' WHEN 2 THEN 'Dev.' || (c_custkey // 3) WHEN 3 THEN 'dev-' || (c_custkey // 3) WHEN 4 THEN 'Admin'
      WHEN 5 THEN '  Dev ' || (c_custkey // 3) || ' ' ELSE 'Dev ' || (c_custkey // 3) END AS name, CASE c_custkey % 13 WHEN 0 THEN c_custkey || '+x@users.noreply.github.com' WHEN 1 THEN NULL
      WHEN 2 THEN 'talbot@corp' || c_custkey || '.example' WHEN 3 THEN 'no-at-' || c_custkey ELSE 'user' || (c_custkey // 2) || '@corp' || (c_custkey % 3) || '.example' END AS email FROM customer)""",
    "patches": """patches AS (SELECT 'f' || p_partkey AS file_path, '--- a' || chr(10) || '+++ b' || chr(10) || repeat('+ x' || chr(10), (p_size % 7)::INTEGER) || ' same' || chr(10)
      || repeat('- y' || chr(10), (p_size % 5)::INTEGER) || '@@ end' AS diff FROM part)""",
    "branches": """branches AS (SELECT lpad(o_orderkey::VARCHAR, 12, '0') AS commit_sha, 'main' AS branch_name, 1 AS branch_ord, o_orderkey AS pos FROM orders UNION ALL
      SELECT lpad(o_orderkey::VARCHAR, 12, '0'), 'b' || (o_orderkey % 2), ((o_orderkey % 2) * 2)::INTEGER, o_orderkey FROM orders WHERE o_orderkey % 3 = 0)""",
}
