"""Column functions against literal cases and Python's own results."""

import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from forgelens.functions import columns as C


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("name", "email", "bot"),
    [
        ("dependabot[bot]", "", True), ("Some[BOT]", "", True), ("GitLab CI", "", True), ("gitlab ci", "", False), ("  web-flow ", "", True), ("Ann", "ann@corp.example", False),
        ("Ann", "NoReply@github.com", True), ("Ann", "abbot@corp.example", True), ("Ann", "29139614+x@users.noreply.github.com", True), (None, None, False), ("", "", False),
    ],
)
def test_is_bot(spark, name, email, bot):
    assert one(spark, C.is_bot(F.col("n"), F.col("e")), n=name, e=email) is bot


def test_bot_names_of_a_project_do_not_leak(spark):
    assert one(spark, C.is_known_bot(F.col("n"), F.col("e"), ("build",)), n="build", e="") is True
    assert one(spark, C.is_bot(F.col("n"), F.col("e")), n="build", e="") is False


@pytest.mark.parametrize(("name", "want"), [("K. Lind-Ek_Sr", "klindeksr"), ("  Mia   Roy  ", "miaroy"), ("\tÉva ", "éva"), ("", "")])
def test_normalized_name(spark, name, want):
    assert one(spark, C.normalized_name(F.col("n")), n=name) == want


@pytest.mark.parametrize("value", ["Ann@Corp.example", "  padded ", "é", ""])
@pytest.mark.parametrize("key", ["k", "a key of more than sixty-four bytes, which has to be hashed before it is used"])
def test_pseudonym_is_hmac(spark, value, key):
    want = hmac.new(key.encode(), value.strip().lower().encode(), hashlib.sha256).hexdigest()[:12]
    assert one(spark, C.pseudonym(F.col("v"), key), v=value) == want


@pytest.mark.parametrize(
    ("path", "score"),
    [("yarn.lock", 0.0), ("frontend/yarn.lock", 0.0), ("package-lock.json", 0.0), ("frontend/package-lock.json", None), ("a/App.MIN.js", 0.0), ("a.js.map", 0.02), ("dist/x", 0.0),
     ("src/dist/x", 0.0), ("locales/en.yml", None), ("app/locales/en.yml", 0.05), (".gitignore", 0.1), ("src/.gitignore", None), ("src/main.py", None)],
)
def test_auto_score(spark, path, score):
    assert one(spark, C.auto_score(F.col("p")), p=path) == score


@pytest.mark.parametrize(
    ("path", "lines", "want"),
    [("README.md", 1, 0.15), ("x/README.MD", 1, 0.15), (".md", 1, 0.9), ("big.json", 501, 0.05), ("big.json", 500, 0.9), ("package.json", 501, 0.9), ("a.py", 999, 0.9), ("dir.md/file", 1, 0.9)],
)
def test_score_caps(spark, path, lines, want):
    assert one(spark, C.capped_score(F.col("p"), F.lit(0.9), F.lit(lines)), p=path) == want


@pytest.mark.parametrize(
    ("reply", "n"),
    [('{"files": [{"path": "a", "score": 0.1}]}', 1), ('```json\n{"files": [{"path": "a"}, {"path": "b"}]}\n```', 2), ('Well: {"files": []} ok', 0), ("nothing", None), ('{"other": 1}', None), (None, None)],
)
def test_parsed_reply(spark, reply, n):
    found = one(spark, F.when(C.parsed_reply(F.col("r")).isNotNull(), F.size(C.parsed_reply(F.col("r"))["files"])), r=reply)
    assert found == n


def test_line_counts_and_truncation(spark):
    diff = "--- a\n+++ b\n+x\n+y\n-z\n same"
    assert one(spark, C.added_lines(F.col("d")), d=diff) == 2
    assert one(spark, C.deleted_lines(F.col("d")), d=diff) == 1
    assert one(spark, C.added_lines(F.col("d")), d=None) == 0
    assert one(spark, C.truncated(F.col("d"), 5), d="123456") == "12345\n... [truncated]"
    assert one(spark, C.truncated(F.col("d"), 5), d=None) == ""


@pytest.mark.parametrize(("before", "after", "want"), [("0", "5", None), ("4", "5", 25.0), ("4", None, -100.0), (None, "1", None)])
def test_pct_change(spark, before, after, want):
    assert one(spark, C.pct_change(F.col("b"), F.col("a")), b=before, a=after) == want


def test_timestamps_ignore_zones(spark):
    for text in ("2026-01-15T10:00:00Z", "2026-01-15T10:00:00+02:00", "2026-01-15T10:00:00"):
        assert str(one(spark, C.utc_timestamp(F.col("t")), t=text)) == "2026-01-15 10:00:00"
    assert one(spark, C.utc_timestamp(F.col("t")), t="soon") is None
