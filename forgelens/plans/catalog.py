"""All queries by name, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forgelens.functions import bodies
from forgelens.functions import columns as C
from forgelens.functions import sql as sql_functions
from forgelens.operators import identity, metrics, rollup, scoring, validation
from forgelens.plans import derive
from forgelens.sources import forge, warehouse

KEY = "a test key, not a secret"
FILTERS = metrics.Filters("1996-01-01", "2001-01-01", excluded=("dev3@corp.example",))
OPEN = metrics.Filters("1996-01-01", "2001-01-01")
PERIODS = (("1996-01-01", "1997-01-01"), ("1999-01-01", "2000-01-01"))
EXCLUDED = ("dev5@corp.example", "DEV9")

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: The SQL over tables that are there already.
OVER_TABLES: dict[str, str] = {}


def query(name: str, tables: str, sql: str | None = None) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Registers a function of derived tables, and the SQL after their common table expressions."""
    names = tables.split()

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(*[getattr(derive, t)(spark, sf_dir) for t in names])
        if sql:
            OVER_TABLES[name] = sql if sql.lstrip().startswith("SELECT") else f"WITH {sql}"
            SQL[name] = "WITH " + ",\n".join(derive.SQL[t] for t in names) + ("\n" if sql.lstrip().startswith("SELECT") else ",\n") + sql
        return f

    return add


def _r(x: str, n: int) -> str:
    return f"round(CAST({x} AS DECIMAL(38,6)), {n})::DOUBLE"


_IN = "authored_date >= TIMESTAMP '1996-01-01' AND authored_date < TIMESTAMP '2001-01-01'"
_WHERE = f"WHERE {_IN} AND author_email NOT IN ('dev3@corp.example')"
_COUNTS = "count(DISTINCT c.commit_sha) AS commits, count(DISTINCT author_email) AS unique_authors"
_SCORED = f"{_r('coalesce(sum(total_productivity), 0)', 2)} AS total_productivity, {_r('coalesce(avg(weighted_score), 0)', 3)} AS avg_weighted_score"
_LINES = "sum(additions + deletions)::BIGINT AS total_lines_changed"
_LEFT = "commits c LEFT JOIN commit_scores s ON c.commit_sha = s.commit_sha"

query("monthly_trends_scored", "commits commit_scores", f"SELECT date_trunc('month', authored_date)::TIMESTAMP AS month, {_COUNTS}, {_SCORED} FROM {_LEFT} {_WHERE} GROUP BY 1")(lambda c, s: metrics.monthly_trends(c, s, FILTERS))
query("monthly_trends_raw", "commits", f"SELECT date_trunc('month', authored_date)::TIMESTAMP AS month, {_COUNTS}, {_LINES} FROM commits c {_WHERE} GROUP BY 1")(lambda c: metrics.monthly_trends(c, None, FILTERS))


def _periods_sql(source: str, measures: str, names: list[str]) -> str:
    parts = []
    for period, (start, end) in zip(("baseline", "comparison"), PERIODS):
        parts.append(f"SELECT '{period}' AS period, {measures} FROM {source} WHERE authored_date >= TIMESTAMP '{start}' AND authored_date < TIMESTAMP '{end}' AND author_email NOT IN ('dev3@corp.example')")
    doubles = ", ".join(f"{n}::DOUBLE AS {n}" for n in names)
    change = ", ".join(_r(f"(coalesce(c.{n}, 0) - coalesce(b.{n}, 0)) / nullif(coalesce(b.{n}, 0), 0) * 100", 1) + f" AS {n}" for n in names)
    return f"""both_ AS ({' UNION ALL '.join(parts)}), d AS (SELECT period, {doubles} FROM both_)
      SELECT * FROM d UNION ALL SELECT '% change', {change} FROM d b, d c WHERE b.period = 'baseline' AND c.period = 'comparison'"""


_DAYS = "count(DISTINCT CAST(authored_date AS DATE)) AS active_days"
query("period_comparison_scored", "commits commit_scores", _periods_sql(_LEFT, f"{_COUNTS}, {_SCORED}, {_DAYS}", ["commits", "unique_authors", "total_productivity", "avg_weighted_score", "active_days"]))(
    lambda c, s: metrics.period_comparison(c, s, FILTERS, *PERIODS)
)
query("period_comparison_raw", "commits", _periods_sql("commits c", f"{_COUNTS}, {_LINES}, {_DAYS}", ["commits", "unique_authors", "total_lines_changed", "active_days"]))(
    lambda c: metrics.period_comparison(c, None, FILTERS, *PERIODS)
)
query(
    "author_productivity_scored", "commits commit_scores",
    f"""a AS (SELECT author_name, author_email, {_COUNTS.split(', ')[0]}, {_SCORED} FROM {_LEFT} WHERE {_IN} GROUP BY 1, 2),
    t AS (SELECT author_email, overall_category, row_number() OVER (PARTITION BY author_email ORDER BY count(*) DESC, overall_category ASC NULLS LAST) AS rn
      FROM commits c JOIN commit_scores s ON c.commit_sha = s.commit_sha WHERE {_IN} GROUP BY 1, 2)
    SELECT author_name, a.author_email, commits, total_productivity, avg_weighted_score, coalesce(overall_category, '-') AS top_category FROM a LEFT JOIN t ON a.author_email = t.author_email AND rn = 1
    ORDER BY total_productivity DESC, a.author_email NULLS LAST, author_name NULLS LAST LIMIT 20""",
)(lambda c, s: metrics.author_productivity(c, s, OPEN))
query(
    "author_productivity_raw", "commits",
    f"SELECT author_name, author_email, {_COUNTS.split(', ')[0]}, {_LINES} FROM commits c WHERE {_IN} GROUP BY 1, 2 ORDER BY total_lines_changed DESC NULLS LAST, author_email NULLS LAST, author_name NULLS LAST LIMIT 20",
)(lambda c: metrics.author_productivity(c, None, OPEN))
_D = "(epoch_us(merged_at) - epoch_us(created_at)) / 86400e6"
query(
    "merge_velocity", "merge_requests",
    f"""SELECT date_trunc('month', created_at)::TIMESTAMP AS month, count(*) AS total_mrs, count(*) FILTER (WHERE state = 'merged') AS merged_count,
      {_r("count(*) FILTER (WHERE state = 'merged') * 100.0::DOUBLE / count(*)", 1)} AS merge_rate_pct, {_r(f"avg({_D})", 2)} AS avg_days_to_merge,
      count(*) FILTER (WHERE state = 'merged' AND {_D} <= 7) AS merged_within_7d, count(*) FILTER (WHERE state = 'merged' AND {_D} <= 30) AS merged_within_30d
    FROM merge_requests WHERE created_at >= TIMESTAMP '1996-01-01' AND created_at < TIMESTAMP '2001-01-01' AND author_email NOT IN ('dev3@corp.example') GROUP BY 1""",
)(lambda m: metrics.merge_velocity(m, FILTERS))
query(
    "category_distribution", "commits commit_scores",
    f"""k AS (SELECT overall_category AS category, count(*) AS commit_count, {_r('avg(weighted_score)', 3)} AS avg_score FROM commits c JOIN commit_scores s ON c.commit_sha = s.commit_sha {_WHERE} GROUP BY 1)
    SELECT category, commit_count, {_r('commit_count * 100.0::DOUBLE / sum(commit_count) OVER ()', 1)} AS pct_of_total, avg_score FROM k""",
)(lambda c, s: metrics.category_distribution(c, s, FILTERS))


def _from_activity(name: str, f: Callable[[DataFrame], DataFrame]) -> None:
    """The query of that name from sums by day: its SQL, which reads commits and scores, has to give the same rows."""
    QUERIES[f"rollup_{name}"], SQL[f"rollup_{name}"], OVER_TABLES[f"rollup_{name}"] = (lambda spark, sf_dir: f(derive.activity(spark, sf_dir))), SQL[name], OVER_TABLES[name]


_from_activity("monthly_trends_scored", lambda a: rollup.monthly_trends(a, FILTERS, True))
_from_activity("monthly_trends_raw", lambda a: rollup.monthly_trends(a, FILTERS, False))
_from_activity("period_comparison_scored", lambda a: rollup.period_comparison(a, FILTERS, True, *PERIODS))
_from_activity("period_comparison_raw", lambda a: rollup.period_comparison(a, FILTERS, False, *PERIODS))
_from_activity("author_productivity_scored", lambda a: rollup.author_productivity(a, OPEN, True))
_from_activity("author_productivity_raw", lambda a: rollup.author_productivity(a, OPEN, False))
_from_activity("category_distribution", lambda a: rollup.category_distribution(a, FILTERS))


def _efficiency_sql(same: str) -> str:
    return f"""h AS (SELECT DISTINCT l.commit_sha FROM mr_commits l JOIN merge_requests m ON l.mr_iid = m.mr_iid AND {same} WHERE state = 'merged')
    SELECT date_trunc('month', authored_date)::TIMESTAMP AS month, sum(additions)::BIGINT AS total_additions, sum(CASE WHEN h.commit_sha IS NOT NULL THEN additions ELSE 0 END)::BIGINT AS merged_additions,
      {_r('sum(CASE WHEN h.commit_sha IS NOT NULL THEN additions ELSE 0 END)::DOUBLE * 100 / nullif(sum(additions), 0)', 1)} AS efficiency_pct
    FROM commits c LEFT JOIN h ON c.commit_sha = h.commit_sha WHERE {_IN} GROUP BY 1"""


query("code_efficiency", "commits merge_requests mr_commits", _efficiency_sql("l.project_id LIKE '%' || m.project_name"))(lambda c, m, x: metrics.code_efficiency(c, m, x, OPEN))
query("code_efficiency_strict", "commits merge_requests mr_commits", _efficiency_sql("(l.project_id = m.project_id OR split_part(l.project_id, '/', -1) = m.project_name)"))(
    lambda c, m, x: metrics.code_efficiency(c, m, x, OPEN, strict=True)
)
query("pct_change", "commits", f"SELECT commit_sha, {_r('(deletions - additions)::DOUBLE / nullif(additions, 0) * 100', 1)} AS change FROM commits")(
    lambda c: c.select("commit_sha", C.pct_change(F.col("additions"), F.col("deletions")).alias("change"))
)

query("existing_shas", "commits", "SELECT DISTINCT commit_sha FROM commits")(warehouse.existing_shas)
_TABLES = ("commits", "commit_scores", "merge_requests", "mr_commits", "diffs")
query("table_counts", " ".join(_TABLES), " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in _TABLES))(lambda *t: warehouse.table_counts(dict(zip(_TABLES, t))))
query("dataset_range", "commits", "SELECT min(authored_date) AS first_commit, max(authored_date) AS last_commit FROM commits")(lambda c: c.agg(F.min("authored_date").alias("first_commit"), F.max("authored_date").alias("last_commit")))
query("extraction_summary", "commits", "SELECT min(committed_date) AS earliest, max(committed_date) AS latest, count(*) AS commits FROM commits")(
    lambda c: c.agg(F.min("committed_date").alias("earliest"), F.max("committed_date").alias("latest"), F.count("*").alias("commits"))
)
query("dataset_summary", "commits", "SELECT count(*) AS commits, min(authored_date) AS earliest, max(authored_date) AS latest, count(DISTINCT author_email) AS authors FROM commits")(
    lambda c: c.agg(F.count("*").alias("commits"), F.min("authored_date").alias("earliest"), F.max("authored_date").alias("latest"), F.countDistinct("author_email").alias("authors"))
)
query("score_category_summary", "commit_scores", f"SELECT overall_category AS category, count(*) AS n, {_r('avg(weighted_score)', 4)} AS avg_score FROM commit_scores GROUP BY 1")(
    lambda s: s.groupBy(F.col("overall_category").alias("category")).agg(F.count("*").alias("n"), C.rounded(F.avg("weighted_score"), 4).alias("avg_score")).orderBy(F.desc("n"), F.asc_nulls_last("category"))
)
query("scoring_backlog", "commits commit_scores", "SELECT (SELECT count(*) FROM commits) AS total, (SELECT count(*) FROM commit_scores) AS scored, (SELECT count(*) FROM commits) - (SELECT count(*) FROM commit_scores) AS unscored")(
    lambda c, s: c.agg(F.count("*").alias("total")).crossJoin(s.agg(F.count("*").alias("scored"))).withColumn("unscored", F.col("total") - F.col("scored"))
)
query("distinct_developers", "commits", "SELECT DISTINCT author_name, author_email FROM commits")(identity.distinct_developers)
query("weekly_commits", "commits", "SELECT date_trunc('week', authored_date)::TIMESTAMP AS week, count(*) AS commits FROM commits GROUP BY 1")(lambda c: c.groupBy(C.week_of(F.col("authored_date")).alias("week")).agg(F.count("*").alias("commits")))
query("high_score_counts", "commit_scores", "SELECT count(*) AS n, count(*) FILTER (WHERE weighted_score > 0.28) AS n_high FROM commit_scores")(lambda s: s.agg(F.count("*").alias("n"), F.count_if(F.col("weighted_score") > 0.28).alias("n_high")))
query("commits_by_score", "commits commit_scores", "SELECT c.commit_sha, author_name, weighted_score FROM commits c JOIN commit_scores s ON c.commit_sha = s.commit_sha ORDER BY weighted_score DESC, c.commit_sha")(
    lambda c, s: c.join(s, "commit_sha").select("commit_sha", "author_name", "weighted_score").orderBy(F.desc("weighted_score"), "commit_sha")
)


def _large(c: DataFrame) -> DataFrame:
    return c.sparkSession.sql("SELECT commit_sha, additions FROM {rows} WHERE additions > :least", args={"least": 100}, rows=c)


query("large_commits", "commits", "SELECT commit_sha, additions FROM commits WHERE additions > 100")(_large)

query("high_watermark", "commits", "SELECT project_path, max(committed_date) AS high_watermark FROM commits GROUP BY 1")(forge.high_watermark)
query("cross_branch_dedup", "branches", "SELECT commit_sha, branch_name, branch_ord, pos FROM branches QUALIFY row_number() OVER (PARTITION BY commit_sha ORDER BY branch_ord, pos) = 1")(forge.first_branch_wins)
query("incremental_anti_join", "branches commits", "SELECT DISTINCT commit_sha FROM branches WHERE commit_sha NOT IN (SELECT commit_sha FROM commits WHERE authored_date < TIMESTAMP '1999-01-01')")(
    lambda b, c: forge.not_stored(b.select("commit_sha").distinct(), c.filter("authored_date < timestamp_ntz'1999-01-01'"), "commit_sha")
)
query("commits_missing_diffs", "commits diffs", "SELECT commit_sha FROM commits WHERE commit_sha NOT IN (SELECT commit_sha FROM diffs)")(lambda c, d: forge.commits_missing_diffs(c, d).select("commit_sha"))
query("mrs_missing_links", "merge_requests mr_commits", "SELECT mr_id, project_id, mr_iid FROM merge_requests m WHERE NOT EXISTS (SELECT 1 FROM mr_commits l WHERE l.project_id = m.project_id AND l.mr_iid = m.mr_iid)")(
    lambda m, x: forge.requests_missing_links(m, x).select("mr_id", "project_id", "mr_iid")
)
query("mr_state", "merge_requests", "SELECT mr_id, CASE WHEN merged_at IS NOT NULL THEN 'merged' WHEN state = 'closed' THEN 'closed' ELSE 'opened' END AS state FROM merge_requests")(
    lambda m: m.select("mr_id", forge.merge_state(F.col("merged_at"), F.col("state")).alias("state"))
)
query(
    "diff_line_counts", "patches",
    "SELECT file_path, len(list_filter(string_split(diff, chr(10)), lambda x: x LIKE '+%' AND x NOT LIKE '+++%'))::INTEGER AS additions, len(list_filter(string_split(diff, chr(10)), lambda x: x LIKE '-%' AND x NOT LIKE '---%'))::INTEGER AS deletions FROM patches",
)(lambda p: p.select("file_path", C.added_lines(F.col("diff")).alias("additions"), C.deleted_lines(F.col("diff")).alias("deletions")))
query("truncate_diff", "patches", "SELECT file_path, CASE WHEN length(diff) > 20 THEN left(diff, 20) || chr(10) || '... [truncated]' ELSE diff END AS shown FROM patches")(
    lambda p: p.select("file_path", C.truncated(F.col("diff"), 20).alias("shown"))
)


def _github_raw(commits: DataFrame, diffs: DataFrame) -> DataFrame:
    """API objects that would give these commits and diffs."""
    person = F.struct(F.col("author_name").alias("name"), F.col("author_email").alias("email"), F.concat(F.date_format("authored_date", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")).alias("date"))
    status = F.when(F.col("deletions") == 1, "added").when(F.col("deletions") == 2, "removed").otherwise("modified")
    file = F.struct(F.col("file_path").alias("filename"), F.lit(None).cast("string").alias("previous_filename"), status.alias("status"), F.lit("+x").alias("patch"), "additions", "deletions")
    files = diffs.groupBy(F.col("commit_sha").alias("sha")).agg(F.collect_list(file).alias("files"))
    rows = commits.withColumn("sha", F.col("commit_sha")).join(files, "sha", "left")
    commit = F.struct(person.alias("author"), person.alias("committer"), F.concat(F.lit("Change "), F.col("sha"), F.lit("\nbody")).alias("message"))
    stats = F.struct("additions", "deletions", (F.col("additions") + F.col("deletions")).alias("total"))
    return rows.select("sha", F.lit("url").alias("html_url"), F.lit("main").alias("branch"), commit.alias("commit"), stats.alias("stats"), F.array(F.struct(F.lit("p1").alias("sha")), F.struct(F.lit("p2").alias("sha"))).alias("parents"), "files")


query(
    "commit_projection", "commits diffs",
    """SELECT commit_sha, 'org/repo' AS project_id, 'repo' AS project_name, author_name, author_email, authored_date, authored_date AS created_at, 'Change ' || commit_sha AS title,
      'Change ' || commit_sha || chr(10) || 'body' AS message, additions, deletions, additions + deletions AS total_changes, 'p1,p2' AS parent_ids FROM commits""",
)(
    lambda c, d: forge.github_commits(_github_raw(c, d), "org/repo").select(
        "commit_sha", "project_id", "project_name", "author_name", "author_email", "authored_date", "created_at", "title", "message", "additions", "deletions", "total_changes", "parent_ids"
    )
)
query("diff_flatten", "commits diffs", "SELECT commit_sha, file_path, file_path AS old_path, deletions = 1 AS new_file, deletions = 2 AS deleted_file, false AS renamed_file, additions, deletions FROM diffs")(
    lambda c, d: forge.github_diffs(_github_raw(c, d)).select("commit_sha", "file_path", "old_path", "new_file", "deleted_file", "renamed_file", "additions", "deletions")
)

_DAY = "yyyy-MM-dd'T'HH:mm:ss"


def _gitlab_raw(m: DataFrame) -> DataFrame:
    text = lambda c: F.concat(F.date_format(c, _DAY), F.lit(".000Z")).alias(c)
    return m.select(F.col("mr_id").cast("long").alias("id"), F.col("mr_iid").cast("long").alias("iid"), F.concat(F.lit("T"), "mr_id").alias("title"), F.lit(None).cast("string").alias("description"), "state",
                    F.struct(F.lit("n").alias("name"), F.col("author_email").alias("email")).alias("author"), text("created_at"), F.lit("soon").alias("updated_at"), text("merged_at"), F.lit(None).cast("string").alias("closed_at"),
                    F.lit("s").alias("source_branch"), F.lit("t").alias("target_branch"), F.lit("u").alias("web_url"))


query(
    "gitlab_merge_requests", "merge_requests",
    "SELECT mr_id, mr_iid, '7' AS project_id, 'repo' AS project_name, 'T' || mr_id AS title, state, 'n' AS author_name, author_email, created_at, NULL::TIMESTAMP AS updated_at, merged_at FROM merge_requests",
)(lambda m: forge.gitlab_merge_requests(_gitlab_raw(m), "7", "org/repo").select("mr_id", "mr_iid", "project_id", "project_name", "title", "state", "author_name", "author_email", "created_at", "updated_at", "merged_at"))
query("merge_links", "mr_commits", "SELECT mr_id, mr_iid, commit_sha, 'org/repo' AS project_id FROM mr_commits")(
    lambda x: forge.merge_links(x.groupBy(F.col("mr_id").cast("long").alias("id"), F.col("mr_iid").cast("long").alias("number")).agg(F.collect_list(F.struct(F.col("commit_sha").alias("sha"))).alias("commits")), "org/repo").drop("extracted_at")
)
query(
    "active_branches", "commits",
    "SELECT commit_sha AS name, CASE WHEN deletions % 7 <> 0 THEN strftime(authored_date, '%Y-%m-%d') END AS last_commit_date FROM commits WHERE deletions % 7 = 0 OR authored_date >= TIMESTAMP '1998-03-01'",
)(lambda c: forge.active_branches(c.select(F.col("commit_sha").alias("name"), F.when(F.col("deletions") % 7 != 0, F.date_format("authored_date", "yyyy-MM-dd")).alias("last_commit_date")), "1998-03-01"))
query("updated_within", "merge_requests", "SELECT mr_id, coalesce(merged_at, created_at) AS updated_at FROM merge_requests WHERE coalesce(merged_at, created_at)::DATE BETWEEN DATE '1997-01-01' AND DATE '1998-01-01'")(
    lambda m: forge.updated_within(m.select("mr_id", F.coalesce("merged_at", "created_at").alias("updated_at")), "1997-01-01", "1998-01-01")
)
query("without_excluded", "commits", "SELECT commit_sha FROM commits WHERE coalesce(author_email, '') <> 'dev5@corp.example' AND author_name NOT IN ('dev5@corp.example', 'dev9')")(
    lambda c: forge.without_excluded(c, ("dev5@corp.example", "dev9")).select("commit_sha")
)
query("hours_to_merge", "merge_requests", "SELECT mr_id, (epoch_us(merged_at) - epoch_us(created_at)) / 86400e6 * 24 AS hours FROM merge_requests WHERE merged_at IS NOT NULL")(
    lambda m: m.filter("merged_at is not null").select("mr_id", C.hours_between(F.col("created_at"), F.col("merged_at")).alias("hours"))
)

_TRIM = r"regexp_replace(coalesce({}, ''), '^\s+|\s+$', '', 'g')"
_N, _E = _TRIM.format("name"), f"lower({_TRIM.format('email')})"
_BOT = f"""({_N} IN ({', '.join(f"'{x}'" for x in C.BOT_NAMES)}) OR lower({_N}) LIKE '%[bot]%' OR {_E} IN ({', '.join(f"'{x}'" for x in C.BOT_EMAILS)}) OR {_E} LIKE '%noreply%' OR {_E} LIKE '%[bot]%'
  OR {_E} LIKE '%bot@%')"""
query("is_bot", "developers", f"SELECT ord, {_BOT} AS bot FROM developers")(lambda d: d.select("ord", C.is_bot(F.col("name"), F.col("email")).alias("bot")))
query("detected_bots", "developers", f"SELECT ord, name, email FROM developers WHERE {_BOT}")(identity.detected_bots)
query("new_bots", "developers", f"SELECT ord, name, email FROM developers WHERE {_BOT} AND name IS DISTINCT FROM 'GitLab CI'")(lambda d: identity.new_bots(d, ("GitLab CI",)))
query("bot_filter", "developers", f"SELECT ord, name AS author_name, email AS author_email FROM developers WHERE NOT {_BOT}")(lambda d: forge.without_bots(d.select("ord", F.col("name").alias("author_name"), F.col("email").alias("author_email"))))
_NORMAL = f"translate(lower({_N}), ' .-_', '')"
query("normalized_names", "developers", f"SELECT ord, {_NORMAL} AS normal, {_NORMAL} IN ({', '.join(f"'{x}'" for x in C.GENERIC_NAMES)}) AS generic FROM developers")(
    lambda d: d.select("ord", C.normalized_name(F.col("name")).alias("normal"), C.is_generic_name(F.col("name")).alias("generic"))
)


def _by_sql(table: str, text: str) -> Callable[[DataFrame], DataFrame]:
    """A query in SQL with the registered functions."""

    def run(rows: DataFrame) -> DataFrame:
        sql_functions.register(rows.sparkSession)
        return rows.sparkSession.sql(text.replace(table, "{rows}"), rows=rows)

    return run


query("sql_is_bot", "developers", f"SELECT ord, {_BOT} AS bot, {_NORMAL} AS normal FROM developers")(_by_sql("DEVELOPERS", "SELECT ord, is_bot(name, email) AS bot, normalized_name(coalesce(name, '')) AS normal FROM DEVELOPERS"))
query("sql_months", "commits", "SELECT date_trunc('month', authored_date)::TIMESTAMP AS month, count(*) AS n, round(CAST((sum(additions) - sum(deletions))::DOUBLE / nullif(sum(deletions)::DOUBLE, 0) * 100 AS DECIMAL(38,6)), 1)::DOUBLE AS more FROM commits GROUP BY 1")(
    _by_sql("COMMITS", "SELECT month_of(authored_date) AS month, count(*) AS n, pct_change(sum(deletions), sum(additions)) AS more FROM COMMITS GROUP BY 1")
)


def _hmac_sql(value: str) -> str:
    inner, outer = (p.hex() for p in C.hmac_pads(KEY))
    trimmed = rf"lower(regexp_replace({value}, '^\s+|\s+$', '', 'g'))"
    return f"left(sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({trimmed})))), 12)"


def _aliases(d: DataFrame) -> DataFrame:
    return d.filter("email is not null and ord % 5 = 0").select(F.upper("email").alias("alias"), F.concat(F.lit("main"), F.col("ord").cast("string"), F.lit("@corp.example")).alias("canonical")).groupBy("alias").agg(F.min("canonical").alias("canonical"))


_ALIASES = "al AS (SELECT lower(email) AS alias, min('main' || ord || '@corp.example') AS canonical FROM developers WHERE email IS NOT NULL AND ord % 5 = 0 GROUP BY 1)"
query("pseudonymize", "developers", f"SELECT ord, {_hmac_sql('name')} AS hash FROM developers")(lambda d: d.select("ord", C.pseudonym(F.col("name"), KEY).alias("hash")))
query("resolve_merge", "developers", f"{_ALIASES} SELECT ord, name, coalesce(canonical, email) AS email FROM developers LEFT JOIN al ON lower(email) = alias")(lambda d: identity.resolve_aliases(d, "email", _aliases(d)))
query(
    "anonymized_commits", "commits developers",
    f"""{_ALIASES} SELECT commit_sha, {_hmac_sql('author_name')} AS author_name, CASE WHEN author_email IS NULL THEN NULL ELSE {_hmac_sql('coalesce(canonical, author_email)')} END AS author_email
    FROM commits LEFT JOIN al ON lower(author_email) = alias""",
)(lambda c, d: identity.anonymized(c.select("commit_sha", "author_name", "author_email"), ("author_name", "author_email"), KEY, _aliases(d)))
query(
    "duplicate_identities", "developers",
    f"""u AS (SELECT ord, name, email, lower({_N}) AS k1, CASE WHEN contains(email, '@') THEN lower(split_part(email, '@', 1)) END AS k2, {_NORMAL} AS k3 FROM developers
      WHERE NOT {_BOT} AND {_NORMAL} NOT IN ({', '.join(f"'{x}'" for x in C.GENERIC_NAMES)})),
    p AS (SELECT a.ord AS oa, b.ord AS ob, a.name AS name_a, a.email AS email_a, b.name AS name_b, b.email AS email_b, 0 AS r, 'exact_name_match' AS reason FROM u a JOIN u b ON a.k1 = b.k1 AND a.k1 <> '' AND a.ord < b.ord
      UNION ALL SELECT a.ord, b.ord, a.name, a.email, b.name, b.email, 1, 'same_local_part' FROM u a JOIN u b ON a.k2 = b.k2 AND a.k2 <> '' AND a.ord < b.ord
      UNION ALL SELECT a.ord, b.ord, a.name, a.email, b.name, b.email, 2, 'normalized_name_match' FROM u a JOIN u b ON a.k3 = b.k3 AND a.k3 <> '' AND a.ord < b.ord)
    SELECT name_a, email_a, name_b, email_b, reason FROM p WHERE lower(email_a) <> lower(email_b)
    QUALIFY row_number() OVER (PARTITION BY least(lower(email_a), lower(email_b)), greatest(lower(email_a), lower(email_b)) ORDER BY r, oa, ob) = 1""",
)(lambda d: identity.duplicate_identities(d.filter(~C.is_bot(F.col("name"), F.col("email")))))

query(
    "identity_groups", "developers",
    f"""u AS (SELECT ord, name, email, lower({_N}) AS k1, CASE WHEN contains(email, '@') THEN lower(split_part(email, '@', 1)) END AS k2, {_NORMAL} AS k3 FROM developers
      WHERE NOT {_BOT} AND {_NORMAL} NOT IN ({', '.join(f"'{x}'" for x in C.GENERIC_NAMES)})),
    x AS (SELECT ord, name, email, '{identity.REASONS[0]}' AS reason, k1 AS k FROM u UNION ALL SELECT ord, name, email, '{identity.REASONS[1]}', k2 FROM u UNION ALL SELECT ord, name, email, '{identity.REASONS[2]}', k3 FROM u),
    g AS (SELECT reason, k, min(ord) AS first, count(*) AS size FROM x WHERE k <> '' GROUP BY 1, 2 HAVING count(*) > 1)
    SELECT x.name, x.email, f.name AS first_name, f.email AS first_email, x.reason, g.size FROM x JOIN g ON x.reason = g.reason AND x.k = g.k JOIN u f ON f.ord = g.first WHERE x.ord <> g.first""",
)(lambda d: identity.identity_groups(d.filter(~C.is_bot(F.col("name"), F.col("email")))))


query(
    "identity_components", "developers",
    f"""u AS (SELECT ord, name, email, lower({_N}) AS k1, CASE WHEN contains(email, '@') THEN lower(split_part(email, '@', 1)) END AS k2, {_NORMAL} AS k3 FROM developers
      WHERE NOT {_BOT} AND {_NORMAL} NOT IN ({', '.join(f"'{x}'" for x in C.GENERIC_NAMES)})),
    x AS (SELECT ord, 1 AS reason, k1 AS k FROM u WHERE k1 <> '' UNION ALL SELECT ord, 2, k2 FROM u WHERE k2 <> '' UNION ALL SELECT ord, 3, k3 FROM u WHERE k3 <> ''),
    g AS (SELECT reason, k, min(ord) AS first FROM x GROUP BY 1, 2 HAVING count(*) > 1),
    e AS (SELECT x.ord AS a, g.first AS b FROM x JOIN g USING (reason, k) UNION SELECT g.first, x.ord FROM x JOIN g USING (reason, k)),
    c AS (WITH RECURSIVE reach AS (SELECT DISTINCT a AS ord, a AS r FROM e UNION SELECT reach.ord, e.b FROM reach JOIN e ON reach.r = e.a) SELECT ord, min(r) AS component FROM reach GROUP BY 1),
    s AS (SELECT component, count(DISTINCT (reason, k)) AS n_shared FROM g JOIN c ON c.ord = g.first GROUP BY 1)
    SELECT d.ord, d.name, d.email, component, count(*) OVER (PARTITION BY component) AS size, n_shared,
      first_value(d.name) OVER w AS canonical_name, first_value(d.email) OVER w AS canonical_email
    FROM c JOIN developers d USING (ord) JOIN s USING (component) WINDOW w AS (PARTITION BY component ORDER BY d.email IS NULL, d.ord)""",
)(lambda d: identity.identity_components(d.filter(~C.is_bot(F.col("name"), F.col("email")))))


def _merges(c: DataFrame) -> DataFrame:
    return c.sparkSession.createDataFrame([(f"dev{i}", f"dev{i % 10}") for i in range(10, 20)], "old string, new string")


query(
    "retroactive_merge", "commits",
    """SELECT commit_sha, CASE WHEN regexp_matches(author_name, '^dev1[0-9]$') THEN 'dev' || right(author_name, 1) ELSE author_name END AS author_name, author_email FROM commits""",
)(lambda c: identity.merged_identities(c.select("commit_sha", "author_name", "author_email"), ("author_name", "author_email"), _merges(c)))
query("developer_roster", "commits", "SELECT author_email, author_name, count(*) AS commit_count FROM commits GROUP BY ALL")(identity.developer_roster)
query(
    "roster_status", "developers",
    f"""SELECT name, coalesce(string_agg(DISTINCT email, ', ' ORDER BY email), '') AS emails, CASE max(CASE WHEN coalesce(email IN ('user7@corp0.example'), false) OR coalesce(name IN ('Admin'), false) THEN 2 WHEN {_BOT} THEN 1 ELSE 0 END)
      WHEN 2 THEN 'Excluded' WHEN 1 THEN 'Bot' ELSE 'Active' END AS status FROM developers GROUP BY name""",
)(lambda d: identity.roster_status(d, ("user7@corp0.example", "Admin")))
query(
    "deanonymize_merged", "commits developers",
    f"""{_ALIASES} SELECT commit_sha, coalesce(canonical, author_email) AS author_email FROM commits LEFT JOIN al ON lower(author_email) = alias WHERE author_email IS NOT NULL""",
)(
    lambda c, d: identity.deanonymized(
        identity.anonymized(c.filter("author_email is not null").select("commit_sha", "author_name", "author_email"), ("author_name", "author_email"), KEY, _aliases(d)),
        identity.identity_map(identity.resolve_aliases(c, "author_email", _aliases(d)), KEY, "authored_date"),
    ).select("commit_sha", "author_email")
)
query(
    "deanonymize", "commits",
    f"SELECT commit_sha, CASE WHEN author_email IS NULL THEN {_hmac_sql('author_name')} ELSE author_name END AS author_name, author_email FROM commits",
)(
    lambda c: identity.deanonymized(
        identity.anonymized(c.select("commit_sha", "author_name", "author_email"), ("author_name", "author_email"), KEY), identity.identity_map(c, KEY, "authored_date")
    )
)

query(
    "unscored_commits", "commits commit_scores",
    "SELECT commit_sha, author_name, author_email FROM commits WHERE commit_sha NOT IN (SELECT commit_sha FROM commit_scores) AND coalesce(lower(author_email), '') <> 'dev5@corp.example' AND lower(author_name) <> 'dev9'",
)(lambda c, s: scoring.unscored_commits(c, s, EXCLUDED).select("commit_sha", "author_name", "author_email"))
query("commit_diff_bundle", "commits diffs", "SELECT commit_sha, count(*)::INTEGER AS n_files, string_agg(file_path, '|' ORDER BY file_path) AS paths FROM commits JOIN diffs USING (commit_sha) GROUP BY 1")(
    lambda c, d: scoring.commit_bundles(c.select("commit_sha"), d.withColumn("diff", F.lit(None).cast("string"))).select("commit_sha", F.size("files").alias("n_files"), F.array_join(F.transform("files", lambda f: f["file_path"]), "|").alias("paths"))
)
_AUTO = "CASE " + " ".join(f"WHEN regexp_matches(lower(file_path), '^(?:{p.lower()})') THEN {s}::DOUBLE" for p, s in C.AUTO_SCORES) + " END"
_CAP = """CASE WHEN lower(file_path) LIKE '%.md' THEN least({0}, 0.15::DOUBLE) WHEN lower(file_path) LIKE '%.json' AND lower(file_path) NOT LIKE '%package.json%' AND additions + deletions > 500 THEN least({0}, 0.05::DOUBLE) ELSE {0} END"""
query("auto_score", "diffs", f"SELECT commit_sha, file_path, {_AUTO} AS auto_score FROM diffs")(lambda d: d.select("commit_sha", "file_path", C.auto_score(F.col("file_path")).alias("auto_score")))
query("sql_scores", "diffs", f"SELECT commit_sha, file_path, {_AUTO} AS auto_score, {_CAP.format('0.75::DOUBLE')} AS score FROM diffs")(
    _by_sql("DIFFS", "SELECT commit_sha, file_path, auto_score(file_path) AS auto_score, capped_score(file_path, 0.75D, additions + deletions) AS score FROM DIFFS")
)
query("score_caps", "diffs", f"SELECT commit_sha, file_path, {_CAP.format('0.75::DOUBLE')} AS score FROM diffs")(
    lambda d: d.select("commit_sha", "file_path", C.capped_score(F.col("file_path"), F.lit(0.75), F.col("additions") + F.col("deletions")).alias("score"))
)
query(
    "file_categories", "diffs",
    f"SELECT commit_sha, file_path, CASE WHEN split_part(file_path, '.', -1) IN ({', '.join(f"'{x}'" for x in C.CATEGORIES)}) THEN split_part(file_path, '.', -1) WHEN lower(split_part(file_path, '/', 2)) IN ({', '.join(f"'{x}'" for x in C.CATEGORIES)}) THEN split_part(file_path, '/', 2) ELSE 'chore' END AS category FROM diffs",
)(lambda d: d.select("commit_sha", "file_path", C.valid_category(F.coalesce(F.when(F.element_at(F.split("file_path", "/"), 2).isin(*C.CATEGORIES), F.element_at(F.split("file_path", "/"), 2)), F.element_at(F.split("file_path", r"\."), -1))).alias("category")))
query(
    "rule_scores", "diffs",
    rf"""SELECT commit_sha, file_path, coalesce({_AUTO}, CASE WHEN additions + deletions > 0 THEN 0.25::DOUBLE + 0.25::DOUBLE * additions / (additions + deletions) ELSE 0 END) AS score,
      CASE WHEN regexp_matches(file_path, '(^|/)tests?/', 'i') THEN 'test' WHEN regexp_matches(file_path, '\.md$', 'i') THEN 'docs' WHEN regexp_matches(file_path, '\.(json|ya?ml|toml|ini)$', 'i') THEN 'config' ELSE 'feature' END AS category FROM diffs""",
)(scoring.rule_scores)


def _scored(d: DataFrame) -> DataFrame:
    files = d.select("commit_sha", "file_path", (F.col("deletions") % 8 / 8.0).alias("score"), F.lit("feature").alias("category"), F.lit(None).cast("string").alias("reasoning"))
    return scoring.scored_files(files, d)


_P = f"f AS (SELECT commit_sha, additions, deletions, {_CAP.format('((deletions % 8)::DOUBLE / 8)')} * greatest(additions, 1) AS p FROM diffs)"
_R4 = "round(CAST({} AS DECIMAL(38,10)), 4)::DOUBLE"
_TP, _WS = _R4.format("sum(p)"), f"coalesce({_R4.format('sum(p) / nullif(sum(additions + deletions), 0)')}, 0)"
query("commit_productivity", "diffs", f"{_P} SELECT commit_sha, {_TP} AS total_productivity, {_WS} AS weighted_score FROM f GROUP BY 1")(lambda d: scoring.commit_productivity(_scored(d)))
query(
    "scoring_summary", "commit_scores diffs",
    f"SELECT count(*) AS n_commits, {_R4.format('avg(weighted_score)')} AS mean_weighted_score, {_R4.format('sum(total_productivity)')} AS total_productivity, (SELECT sum(additions + deletions)::BIGINT FROM diffs) AS total_lines FROM commit_scores",
)(lambda s, d: scoring.scoring_summary(s, d.withColumn("lines", F.col("additions") + F.col("deletions"))))
query("category_counts", "commit_scores", "SELECT coalesce(overall_category, 'unknown') AS category, count(*) AS n, floor(count(*) * 100 / sum(count(*)) OVER ())::BIGINT AS pct FROM commit_scores GROUP BY 1")(scoring.category_counts)

QUERIES["parse_model_json"] = lambda spark, sf_dir: scoring.reply_files(derive.replies(spark, sf_dir)).select("commit_sha", "file_path", "score", C.valid_category(F.col("category")).alias("category"))
SQL["parse_model_json"] = """SELECT lpad(o_orderkey::VARCHAR, 12, '0') AS commit_sha, 'a.py' AS file_path, ((o_orderkey % 9 + 1)::DOUBLE / 10) AS score,
  CASE o_orderkey % 3 WHEN 0 THEN 'feature' WHEN 1 THEN 'chore' ELSE 'test' END AS category FROM orders WHERE o_orderkey % 4 <> 3"""


def _snapshots(c: DataFrame, s: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A result, and a snapshot of it that differs in places."""
    now = metrics.monthly_trends(c, s, FILTERS).withColumn("month", F.date_format("month", "yyyy-MM"))
    n = F.substring("month", 6, 2).cast("int")
    then = now.filter("month <> '1996-05'").withColumns({"commits": F.col("commits") + (n == 3).cast("int"), "avg_weighted_score": F.col("avg_weighted_score") + F.when(n == 4, 0.005).when(n == 5, 0.5).otherwise(0.0)})
    return now, then.unionByName(now.limit(1).withColumn("month", F.lit("1980-01")))


_M = ("commits", "avg_weighted_score")  # the snapshot has these two
query(
    "validate_monthly", "commits commit_scores",
    f"""m AS (SELECT strftime(date_trunc('month', authored_date), '%Y-%m') AS month, {_COUNTS}, {_SCORED} FROM {_LEFT} {_WHERE} GROUP BY 1),
    t AS (SELECT month, commits AS now_commits, avg_weighted_score AS now_score, commits + (right(month, 2) = '03')::INTEGER AS commits, avg_weighted_score + CASE right(month, 2) WHEN '04' THEN 0.005 WHEN '05' THEN 0.5 ELSE 0 END AS score
      FROM m WHERE month <> '1996-05')
    SELECT 'monthly_trends[' || month || '].commits' AS metric, CASE WHEN commits = now_commits THEN 'PASS' ELSE 'FAIL' END AS status FROM t UNION ALL
    SELECT 'monthly_trends[' || month || '].avg_weighted_score', CASE right(month, 2) WHEN '04' THEN 'OK' WHEN '05' THEN 'FAIL' ELSE 'PASS' END FROM t UNION ALL
    SELECT 'monthly_trends[1980-01].' || x, 'FAIL' FROM (VALUES ('commits'), ('avg_weighted_score')) v(x)""",
)(lambda c, s: validation.compare_by_key(*_snapshots(c, s)[::-1], "month", _M, "monthly_trends").select("metric", "status"))
query(
    "validate_scalars", "commits",
    "SELECT 'total_additions' AS metric, commit_sha, CASE WHEN deletions % 4 = 0 THEN 'PASS' WHEN deletions % 4 = 1 THEN 'OK' ELSE 'FAIL' END AS status FROM commits",
)(
    lambda c: c.select(
        F.lit("total_additions").alias("metric"), "commit_sha",
        validation.status_of(F.lit("total_additions"), F.lit("1.5"), F.element_at(F.array(F.lit("1.5"), F.lit("1.505"), F.lit("2.5"), F.lit(None).cast("string")), F.col("deletions") % 4 + 1)).alias("status"),
    )
)


def _moved(c: DataFrame) -> DataFrame:
    """A ranking in which the fourth author has the first one's place, and one that is shorter."""
    now = metrics.author_productivity(c, None, OPEN).select("author_name", "total_lines_changed")
    other = now.withColumn("total_lines_changed", F.col("total_lines_changed") + F.when(F.col("author_name").endswith("4"), 10**9).otherwise(0))
    sides = {"same": now, "moved": other, "shorter": now.orderBy(F.desc("total_lines_changed"), "author_name").limit(4)}
    out = [validation.compare_ranking(side, now, "author_name", "total_lines_changed").withColumn("metric", F.lit(name)) for name, side in sides.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


query(
    "validate_ranking", "commits",
    f"""a AS (SELECT author_name, author_email, {_LINES} FROM commits c WHERE {_IN} GROUP BY 1, 2 ORDER BY 3 DESC NULLS LAST, 2 NULLS LAST, 1 NULLS LAST LIMIT 20),
    m AS (SELECT author_name, total_lines_changed + CASE WHEN author_name LIKE '%4' THEN 1000000000 ELSE 0 END AS x FROM a),
    l AS (SELECT (SELECT string_agg(author_name, ',' ORDER BY total_lines_changed DESC, author_name) FROM (SELECT * FROM a ORDER BY total_lines_changed DESC, author_name LIMIT 10)) AS now,
      (SELECT string_agg(author_name, ',' ORDER BY x DESC, author_name) FROM (SELECT * FROM m ORDER BY x DESC, author_name LIMIT 10)) AS moved, least(10, (SELECT count(*) FROM a)) AS n)
    SELECT 'same' AS metric, 'PASS' AS status, n::BIGINT AS n_compared FROM l UNION ALL SELECT 'moved', CASE WHEN now = moved THEN 'PASS' ELSE 'FAIL' END, n::BIGINT FROM l UNION ALL SELECT 'shorter', 'PASS', least(4, n)::BIGINT FROM l""",
)(_moved)


query(
    "validate_authors", "commits commit_scores",
    f"""a AS (SELECT author_name, author_email, {_COUNTS.split(', ')[0]}, {_SCORED} FROM {_LEFT} WHERE {_IN} AND author_email IS NOT NULL GROUP BY 1, 2 ORDER BY total_productivity DESC, author_email, author_name LIMIT 20),
    e AS (SELECT author_email FROM a)
    SELECT 'author_ranking' AS metric, 'PASS' AS status UNION ALL SELECT 'author[' || author_email || '].commits', CASE WHEN split_part(author_email, '@', 1) LIKE '%2' THEN 'FAIL' ELSE 'PASS' END FROM e
    UNION ALL SELECT 'author[' || author_email || '].total_productivity', CASE WHEN split_part(author_email, '@', 1) LIKE '%3' THEN 'OK' ELSE 'PASS' END FROM e""",
)(
    lambda c, s: (
        lambda now: validation.compare_authors(
            now.select(F.col("author_email").alias("author"), (F.col("commits") + F.col("author_email").like("%2@%").cast("int")).alias("commits"), (F.col("total_productivity") + F.when(F.col("author_email").like("%3@%"), 0.005).otherwise(0.0)).alias("total_productivity")), now
        ).select("metric", "status")
    )(metrics.author_productivity(c.filter("author_email is not null"), s, OPEN))
)
query(
    "validate_repeated_authors", "commits",
    f"""a AS (SELECT author_email, count(*) AS n FROM commits WHERE {_IN} AND author_email IS NOT NULL GROUP BY 1)
    SELECT 'author[' || author_email || '].commits' AS metric, n::VARCHAR AS reference, n::VARCHAR AS result, 'PASS' AS status FROM a
    UNION ALL SELECT 'author[' || author_email || '].total_productivity', 'NaN', NULL, 'FAIL' FROM a""",
)(
    lambda c: (
        lambda now: validation.compare_by_key(
            now.withColumn("total_productivity", F.lit("NaN")), now.withColumn("commits", F.col("commits") + 4).unionByName(now), "author_email", ("commits", "total_productivity"), "author"
        ).select("metric", "reference", "result", "status")
    )(OPEN.commits(c).filter("author_email is not null").groupBy("author_email").agg(F.count("*").alias("commits")))
)
query(
    "validate_categories", "commits commit_scores",
    f"""k AS (SELECT DISTINCT coalesce(overall_category, 'none') AS c FROM commits c JOIN commit_scores s ON c.commit_sha = s.commit_sha {_WHERE} AND overall_category IS NOT NULL)
    SELECT 'category[' || c || '].count' AS metric, CASE WHEN c = 'docs' THEN 'FAIL' ELSE 'PASS' END AS status FROM k UNION ALL SELECT 'category[' || c || '].percentage', CASE WHEN c = 'bugfix' THEN 'OK' ELSE 'PASS' END FROM k
    UNION ALL SELECT 'category[gone].' || x, 'FAIL' FROM (VALUES ('count'), ('percentage')) v(x)""",
)(
    lambda c, s: (
        lambda now: validation.compare_categories(
            now.select("category", (F.col("commit_count") + (F.col("category") == "docs").cast("int")).alias("count"), (F.col("pct_of_total") + F.when(F.col("category") == "bugfix", 0.005).otherwise(0.0)).alias("percentage"))
            .unionByName(now.limit(1).select(F.lit("gone").alias("category"), F.lit(1).cast("long").alias("count"), F.lit(1.0).alias("percentage"))), now
        ).select("metric", "status")
    )(metrics.category_distribution(c, s, FILTERS).filter("category is not null"))
)


def _typed_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields that keep their type, where others of the same answer don't."""
    rows = derive.bodies(spark, sf_dir).select("commit_sha", bodies.typed(F.col("body"), forge.GITLAB_MERGE).alias("m"))
    return rows.select("commit_sha", "m.id", "m.title", F.col("m.author.name").alias("author_name"), F.col("m.commits")[0]["id"].alias("first_commit"))


_WHOLE = "o_orderkey % 11 <> 0"
QUERIES["typed_bodies"] = _typed_bodies
SQL["typed_bodies"] = f"""SELECT lpad(o_orderkey::VARCHAR, 12, '0') AS commit_sha, CASE WHEN {_WHOLE} THEN CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN 17 ELSE o_orderkey END END::BIGINT AS id,
  CASE WHEN {_WHOLE} THEN CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '5' ELSE 't' END END AS title, CASE WHEN {_WHOLE} AND o_orderkey % 7 > 1 THEN 'n' END AS author_name,
  CASE WHEN {_WHOLE} THEN CASE o_orderkey % 4 WHEN 0 THEN 'true' ELSE 's' END END AS first_commit FROM orders"""
QUERIES["body_drift"] = lambda spark, sf_dir: bodies.drift(derive.bodies(spark, sf_dir), forge.GITLAB_MERGE)
SQL["body_drift"] = f"""SELECT field, wanted, found, count(*) AS n, count(*) FILTER (WHERE lost) AS n_lost FROM (
  SELECT 'id' AS field, 'BIGINT' AS wanted, CASE WHEN o_orderkey % 5 = 1 THEN 'OBJECT' ELSE 'STRING' END AS found, o_orderkey % 5 < 2 AS lost FROM orders WHERE {_WHOLE} AND o_orderkey % 5 < 3
  UNION ALL SELECT 'title', 'STRING', CASE WHEN o_orderkey % 3 = 0 THEN 'ARRAY' ELSE 'BIGINT' END, o_orderkey % 3 = 0 FROM orders WHERE {_WHOLE} AND o_orderkey % 3 < 2
  UNION ALL SELECT 'author', 'OBJECT', 'STRING', true FROM orders WHERE {_WHOLE} AND o_orderkey % 7 = 0
  UNION ALL SELECT 'commits[].id', 'STRING', 'BOOLEAN', false FROM orders WHERE {_WHOLE} AND o_orderkey % 4 = 0
  UNION ALL SELECT '', 'OBJECT', 'BROKEN', true FROM orders WHERE NOT ({_WHOLE})) GROUP BY ALL"""
