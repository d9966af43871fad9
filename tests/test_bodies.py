"""A field of another type costs that field and nothing else of its answer."""

import json

from pyspark.sql import functions as F

from forgelens.functions.bodies import drift, typed
from forgelens.sources.forge import GITHUB_COMMIT, GITLAB_COMMIT, GITLAB_MERGE, github_commits, github_diffs


def commit(**change):
    who = {"name": "a", "email": "a@x.example", "date": "2026-01-02T03:04:05Z"}
    return {"sha": "s", "html_url": "u", "commit": {"author": who, "committer": who, "message": "m"}, "stats": {"additions": 3, "deletions": 1, "total": 4}, "parents": [{"sha": "p"}],
            "files": [{"filename": "a.py", "status": "added", "patch": "+x", "additions": 3, "deletions": 1}, {"filename": "b.py", "status": "removed", "patch": None, "additions": 0, "deletions": 0}]} | change


def parsed(spark, bodies, schema=GITHUB_COMMIT):
    return spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, body string").select("i", typed(F.col("body"), schema).alias("c")).select("i", F.col("c").isNull().alias("none"), "c.*").orderBy("i")


def test_answers_of_the_right_type_are_as_before(spark):
    bodies = [json.dumps(commit()), json.dumps(commit(files=[], parents=None)), "{}"]
    new = parsed(spark, bodies)
    old = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, body string").select("i", F.from_json("body", GITHUB_COMMIT).alias("c")).select("i", "c.*")
    for project in (lambda r: github_commits(r, "o/r"), github_diffs):
        a, b = ([tuple(r) for r in project(x).drop("extracted_at").orderBy("commit_sha").collect()] for x in (new, old))
        assert a == b


def test_one_field_is_lost(spark):
    rows = parsed(spark, [json.dumps(x) for x in (commit(stats=[1, 2]), commit(stats={"additions": {"n": 3}, "deletions": "1", "total": 4}), commit(commit="gone"), commit(files=[{"filename": "a.py", "additions": "many"}, None, "odd", {"filename": "b.py", "additions": 2}]))]).collect()
    assert [r["sha"] for r in rows] == ["s"] * 4 and [r["html_url"] for r in rows] == ["u"] * 4
    assert rows[0]["stats"]["total"] is None and (rows[1]["stats"]["additions"], rows[1]["stats"]["deletions"], rows[1]["stats"]["total"]) == (None, 1, 4)
    assert rows[2]["commit"]["message"] is None and rows[2]["stats"]["total"] == 4
    assert [(f["filename"], f["additions"]) for f in rows[3]["files"]] == [("a.py", None), (None, None), (None, None), ("b.py", 2)]


def test_odd_texts(spark):
    rows = parsed(spark, [None, "", "{", "[]", "7", "null", '{"sha": "1", "sha": "2"}', json.dumps({"sha": "x" * 3_000_000})]).collect()
    assert [r["sha"] for r in rows[:6]] == [None] * 6 and rows[6]["sha"] == "2" and len(rows[7]["sha"]) == 3_000_000 and rows[0]["none"]


def test_drift_counts_each_value(spark):
    bodies = [json.dumps({"id": "x", "commits": [{"id": 1}, {"id": {"a": 1}}, "s"], "author": None}), json.dumps({"id": 1, "more": {}}), "[]", "{", None]
    found = {(r["field"], r["found"]): (r["wanted"], r["n"], r["n_lost"]) for r in drift(spark.createDataFrame([(b,) for b in bodies], "body string"), GITLAB_MERGE).collect()}
    assert found == {
        ("id", "STRING"): ("BIGINT", 1, 1), ("commits[].id", "BIGINT"): ("STRING", 1, 0), ("commits[].id", "OBJECT"): ("STRING", 1, 1), ("commits[]", "STRING"): ("OBJECT", 1, 1),
        ("", "ARRAY"): ("OBJECT", 1, 1), ("", "BROKEN"): ("OBJECT", 1, 1),
    }
    assert drift(spark.createDataFrame([], "body string"), GITLAB_MERGE).count() == 0


def test_an_answer_is_parsed_once(spark):
    rows = spark.createDataFrame([("{}",)], "body string")
    for found in (drift(rows, GITLAB_MERGE), rows.select(typed(F.col("body"), GITLAB_COMMIT))):
        assert found._jdf.queryExecution().optimizedPlan().toString().count("parseJson(") == 1
