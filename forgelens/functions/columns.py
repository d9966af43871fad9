"""Column functions: no Python runs on the executors."""

from __future__ import annotations

import hashlib
import operator
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names, addresses and address patterns of automated accounts.
BOT_NAMES = (
    "dependabot[bot]", "renovate[bot]", "github-actions[bot]", "GitLab CI", "Administrator", "Mergify", "Codecov", "Snyk Bot", "greenkeeper[bot]", "semantic-release-bot", "web-flow",
)
BOT_EMAILS = ("noreply@github.com", "49699333+dependabot[bot]@users.noreply.github.com", "bot@renovateapp.com", "action@github.com", "gitlab@localhost")
BOT_EMAIL_PATTERNS = (r".*\[bot\]@.*", r".*noreply@.*", r".*bot@.*", r"^29139614\+.*@users\.noreply\.github\.com$")

# Normalised names that say nothing about who it is.
GENERIC_NAMES = ("admin", "administrator", "bot", "ci", "noreply", "no-reply", "root", "system", "unknown")

# Scores of trivial files by path, first match first.
AUTO_SCORES = (
    (r".*\.lock$", 0.0), (r"yarn\.lock$", 0.0), (r"Gemfile\.lock$", 0.0), (r"package-lock\.json$", 0.0), (r"pnpm-lock\.yaml$", 0.0), (r"composer\.lock$", 0.0),
    (r"Pipfile\.lock$", 0.0), (r"poetry\.lock$", 0.0), (r"Cargo\.lock$", 0.0), (r".*\.min\.js$", 0.0), (r".*\.min\.css$", 0.0), (r".*\.map$", 0.02),
    (r"^generated/.*", 0.0), (r"^dist/.*", 0.0), (r"^build/.*", 0.0), (r".*/generated/.*", 0.0), (r".*/dist/.*", 0.0), (r".*/build/.*", 0.0),
    (r".*/locales/.*\.yml$", 0.05), (r".*/locales/.*\.yaml$", 0.05), (r".*/i18n/.*\.yml$", 0.05), (r".*/i18n/.*\.json$", 0.05), (r".*/translations/.*", 0.05), (r"\.gitignore$", 0.1),
)
# Caps by file type, and the categories of changes.
MARKDOWN_CAP, JSON_CAP, JSON_LINES = 0.15, 0.05, 500
CATEGORIES = ("feature", "bugfix", "refactor", "test", "docs", "style", "perf", "security", "deps", "config", "chore", "localization")


def rounded(value: Column, digits: int) -> Column:
    """Half up on the decimal value, the same in every engine."""
    return F.round(value.cast("decimal(38,6)"), digits).cast("double")


def month_of(ts: Column) -> Column:
    return F.date_trunc("month", ts).cast("timestamp_ntz")


def week_of(ts: Column) -> Column:
    return F.date_trunc("week", ts).cast("timestamp_ntz")


def days_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(86400e6)


def hours_between(start: Column, end: Column) -> Column:
    return days_between(start, end) * 24


def utc_timestamp(text: Column) -> Column:
    """ISO text without regard to its zone; null if it can't be read."""
    return F.try_to_timestamp(F.regexp_replace(text, r"(Z|[+-]\d\d:?\d\d)$", "")).cast("timestamp_ntz")


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_bot(name: Column, email: Column) -> Column:
    name, email = stripped(F.coalesce(name, F.lit(""))), F.lower(stripped(F.coalesce(email, F.lit(""))))
    patterns = [email.rlike(f"(?diu)^(?:{p})") for p in BOT_EMAIL_PATTERNS]
    return reduce(operator.or_, [name.isin(*BOT_NAMES), F.lower(name).contains("[bot]"), email.isin(*BOT_EMAILS), email.contains("noreply"), email.contains("[bot]"), *patterns])


def is_known_bot(name: Column, email: Column, more_names: tuple[str, ...] = ()) -> Column:
    """With names that a project adds."""
    return is_bot(name, email) | stripped(F.coalesce(name, F.lit(""))).isin(*more_names) if more_names else is_bot(name, email)


def normalized_name(name: Column) -> Column:
    return F.translate(F.lower(stripped(name)), " .-_", "")


def is_generic_name(name: Column) -> Column:
    return normalized_name(name).isin(*GENERIC_NAMES)


def hmac_pads(key: str | bytes) -> tuple[bytes, bytes]:
    """Inner and outer pad; they are as secret as the key and show in query plans."""
    raw = key.encode() if isinstance(key, str) else key
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in raw), bytes(b ^ 0x5C for b in raw)


def pseudonym(value: Column, key: str | bytes) -> Column:
    """First 12 hex digits of HMAC-SHA256 of the lower-case stripped value."""
    inner, outer = (F.unhex(F.lit(p.hex())) for p in hmac_pads(key))
    first = F.unhex(F.sha2(F.concat(inner, F.encode(F.lower(stripped(value)), "UTF-8")), 256))
    return F.substring(F.sha2(F.concat(outer, first), 256), 1, 12)


def auto_score(path: Column) -> Column:
    """The fixed score of a trivial file, else null."""
    out = F.lit(None).cast("double")
    for pattern, score in reversed(AUTO_SCORES):
        out = F.when(path.rlike(f"(?diu)^(?:{pattern})"), F.lit(score)).otherwise(out)
    return out


def extension(path: Column) -> Column:
    """From the last dot of the last segment, unless all before it are dots; lower-case."""
    return F.regexp_extract(F.lower(path), r"(?:^|/)\.*[^/.][^/]*?(\.[^./]*)$", 1)


def capped_score(path: Column, score: Column, lines: Column) -> Column:
    ext = extension(path)
    score = F.when(ext == ".md", F.least(score, F.lit(MARKDOWN_CAP))).otherwise(score)
    big = (ext == ".json") & ~F.lower(path).contains("package.json") & (lines > JSON_LINES)
    return F.when(big, F.least(score, F.lit(JSON_CAP))).otherwise(score)


def truncated(text: Column, limit: int, marker: str = "\n... [truncated]") -> Column:
    text = F.coalesce(text, F.lit(""))
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(marker))).otherwise(text)


def valid_category(category: Column) -> Column:
    return F.when(category.isin(*CATEGORIES), category).otherwise("chore")


def added_lines(diff: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(diff, F.lit("")), "\n"), lambda x: x.startswith("+") & ~x.startswith("+++")))


def deleted_lines(diff: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(diff, F.lit("")), "\n"), lambda x: x.startswith("-") & ~x.startswith("---")))


def pct_change(before: Column, after: Column) -> Column:
    """Null where there was nothing before."""
    b, a = F.coalesce(before.cast("double"), F.lit(0.0)), F.coalesce(after.cast("double"), F.lit(0.0))
    return rounded((a - b) / F.nullif(b, F.lit(0.0)) * 100, 1)


REPLY = "struct<files: array<struct<path: string, score: double, category: string, reasoning: string>>, overall_category: string, flags: array<string>>"


def parsed_reply(reply: Column) -> Column:
    """A model's reply as a struct: as it is, without code fences, or its widest braces; null if none is JSON with files."""
    bare = F.regexp_replace(stripped(reply), r"(?s)^```[A-Za-z]*\s*|\s*```$", "")
    tries = [F.from_json(x, REPLY) for x in (bare, F.regexp_extract(reply, r"(?s)\{.*\}", 0))]
    return F.coalesce(*[F.when(t["files"].isNotNull(), t) for t in tries])
