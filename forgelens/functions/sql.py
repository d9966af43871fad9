"""The column functions for those who write SQL: temporary SQL functions, which Spark inlines into the plan."""

from __future__ import annotations

from pyspark.sql import SparkSession

from forgelens.functions import columns as C


def _text(value: str) -> str:
    """A literal whose backslashes stay."""
    return "r'" + value + "'"


def _listed(values: tuple[str, ...]) -> str:
    return ", ".join(map(_text, values))


def _stripped(x: str) -> str:
    return rf"regexp_replace({x}, r'(?U)^\s+|\s+$', '')"


def _bot() -> str:
    name, email = _stripped("coalesce(name, '')"), f"lower({_stripped("coalesce(email, '')")})"
    patterns = [f"{email} RLIKE {_text(f'(?diu)^(?:{p})')}" for p in C.BOT_EMAIL_PATTERNS]
    return " OR ".join([f"{name} IN ({_listed(C.BOT_NAMES)})", f"contains(lower({name}), '[bot]')", f"{email} IN ({_listed(C.BOT_EMAILS)})", f"contains({email}, 'noreply')", f"contains({email}, '[bot]')", *patterns])


def _auto() -> str:
    return "CASE " + " ".join(f"WHEN path RLIKE {_text(f'(?diu)^(?:{p})')} THEN {s}D" for p, s in C.AUTO_SCORES) + " END"


_EXTENSION = r"regexp_extract(lower(path), r'(?:^|/)\.*[^/.][^/]*?(\.[^./]*)$', 1)"

#: What stands behind CREATE TEMPORARY FUNCTION, by name.
FUNCTIONS: dict[str, str] = {
    "is_bot": f"(name STRING, email STRING) RETURNS BOOLEAN RETURN {_bot()}",
    "normalized_name": f"(name STRING) RETURNS STRING RETURN translate(lower({_stripped('name')}), ' .-_', '')",
    "auto_score": f"(path STRING) RETURNS DOUBLE RETURN {_auto()}",
    "capped_score": f"""(path STRING, score DOUBLE, lines INT) RETURNS DOUBLE RETURN CASE WHEN {_EXTENSION} = '.md' THEN least(score, {C.MARKDOWN_CAP}D)
      WHEN {_EXTENSION} = '.json' AND NOT contains(lower(path), 'package.json') AND lines > {C.JSON_LINES} THEN least(score, {C.JSON_CAP}D) ELSE score END""",
    "valid_category": f"(category STRING) RETURNS STRING RETURN CASE WHEN category IN ({_listed(C.CATEGORIES)}) THEN category ELSE 'chore' END",
    "pct_change": "(before DOUBLE, after DOUBLE) RETURNS DOUBLE RETURN CAST(round(CAST((coalesce(after, 0D) - coalesce(before, 0D)) / nullif(coalesce(before, 0D), 0D) * 100 AS DECIMAL(38,6)), 1) AS DOUBLE)",
    "month_of": "(ts TIMESTAMP_NTZ) RETURNS TIMESTAMP_NTZ RETURN CAST(date_trunc('month', ts) AS TIMESTAMP_NTZ)",
    "days_between": "(since TIMESTAMP_NTZ, until TIMESTAMP_NTZ) RETURNS DOUBLE RETURN (unix_micros(CAST(until AS TIMESTAMP)) - unix_micros(CAST(since AS TIMESTAMP))) / 86400e6D",
    # a row for each line of a diff: where it stands (from 1), '+', '-', '@' (a hunk's head) or ' ', and the rest of it
    "diff_lines": """(diff STRING) RETURNS TABLE (line INT, kind STRING, content STRING) RETURN
      SELECT pos + 1, CASE WHEN x LIKE '+++%' OR x LIKE '---%' THEN ' ' WHEN left(x, 1) IN ('+', '-') THEN left(x, 1) WHEN x LIKE '@@%' THEN '@' ELSE ' ' END,
        CASE WHEN left(x, 1) IN ('+', '-') AND NOT (x LIKE '+++%' OR x LIKE '---%') THEN substr(x, 2) ELSE x END FROM (SELECT posexplode(split(diff, r'\\n')) AS (pos, x))""",
}


def register(spark: SparkSession) -> None:
    """Makes the functions known to a session; again changes nothing."""
    for name, definition in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{definition}")
