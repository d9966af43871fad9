"""Settings, phrases, reports and the command line."""

import datetime as dt

import pytest

from forgelens import cli, config, phrases, report
from forgelens.sources.warehouse import Warehouse


def test_config(tmp_path):
    (tmp_path / ".env").write_text("PROVIDER=gitlab\nREPOS=a/b, c/d\nALIASES=x@a:y@a,bad\nSCORING=Yes\nANONYMIZE=0\n# EXCLUDED=no\nWAREHOUSE=w\nOTHER=1\n")
    c = config.load(str(tmp_path / ".env"))
    assert (c.repos, c.aliases, c.scoring, c.anonymize, c.excluded) == (("a/b", "c/d"), {"x@a": "y@a"}, True, False, ()) and c.warehouse == str(tmp_path / "w")
    assert c.problems() == ["gitlab needs a base URL"]
    assert c.with_alias("A@b", "C@d").aliases["a@b"] == "c@d" and c.with_alias("a", "A") is c


@pytest.mark.parametrize(
    ("text", "since", "until"),
    [("Q1 2026", "2026-01-01", "2026-04-01"), ("last 3 months", "2026-02-28", "2026-06-01"), ("January 2026", "2026-01-01", "2026-02-01"), ("2025-06 to 2025-12", "2025-06-01", "2026-01-01"),
     ("2025", "2025-01-01", "2026-01-01"), ("last 2 weeks", "2026-05-17", "2026-06-01"), ("2026-01-01 to 2026-01-31", "2026-01-01", "2026-02-01"), ("soon", None, None)],
)
def test_phrases(text, since, until):
    got = phrases.span(text, dt.date(2026, 5, 31))
    assert got == (None if since is None else (dt.date.fromisoformat(since), dt.date.fromisoformat(until)))


def test_report_and_cli(spark, tmp_path, capsys):
    t = spark.createDataFrame([("a", 1234.5, None)], "author string, x double, y int")
    assert report.markdown(t).splitlines()[2] == "| a | 1,234.50 | - |" and report.shown(12.3456789) == "12.3456789" and report.markdown(t.limit(0)) == "_No data._" and report.as_csv(t) == "author,x,y\na,1234.5,\n" and '"y": null' in report.as_json(t)
    assert "## Author list" in report.report("T", ("a", "b"), {"author_list": t})
    store = Warehouse(spark, str(tmp_path / "w"))
    store.create_tables()
    store.insert("commits", [{"commit_sha": "s", "project_path": "o/r", "author_email": "e", "authored_date": dt.datetime(2026, 1, 2), "additions": 1, "deletions": 1}])
    (tmp_path / ".env").write_text("REPOS=o/r\nWAREHOUSE=w\n")
    cli.main(["--config", str(tmp_path / ".env"), "--query", "all"])
    out = capsys.readouterr().out
    assert "| 2026-01-01 | 1 | 1 | 2 |" in out and "no scores" in out


def test_commands(spark, tmp_path, capsys):
    """Extract, score, take a snapshot, validate it, spoil it, report, merge."""
    env = tmp_path / ".env"
    env.write_text(f"REPOS=team/a\nBASE_URL=https://hub.invalid\nWAREHOUSE=w\nKEY={'0f' * 32}\n")
    run = lambda *more: cli.main([more[0], "--config", str(env), *more[1:]])
    shot = str(tmp_path / "s.json")
    assert run("extract", "--transport", "tests.forge_double:github") == 0 and "commits: 3" in capsys.readouterr().out
    assert run("score") == 0 and "scored by rule: 3" in capsys.readouterr().out
    assert run("snapshot", "--file", shot, "--since", "2026-01-01", "--until", "2027-01-01") == 0
    assert run("validate", "--file", shot) == 0 and "0 FAIL" in capsys.readouterr().out
    (tmp_path / "s.json").write_text((tmp_path / "s.json").read_text().replace('"commits": 3', '"commits": 4'))
    assert run("validate", "--file", shot) == 1 and "1 FAIL" in capsys.readouterr().out
    (tmp_path / "none.json").write_text("{}")
    assert run("validate", "--file", str(tmp_path / "none.json")) == 0 and "No comparisons" in capsys.readouterr().out
    assert run("report", "--since", "2026-01-01", "--until", "2027-01-01", "--baseline-start", "2026-01-01", "--baseline-end", "2026-03-01", "--comparison-start", "2026-03-01", "--comparison-end", "2026-04-01") == 0
    text = capsys.readouterr().out
    assert all(f"## {n.replace('_', ' ').capitalize()}" in text for n in cli.NAMES)
    before = {r[0] for r in Warehouse(spark, str(tmp_path / "w")).table("commits").select("author_email").collect()}
    assert run("merge", "--canonical", "dev1@team.example", "--alias", "dev2@team.example") == 0 and "values changed: 2" in capsys.readouterr().out
    after = {r[0] for r in Warehouse(spark, str(tmp_path / "w")).table("commits").select("author_email").collect()}
    assert len(before) == 3 and len(after) == 2 and "merged_into" in (tmp_path / "people.json").read_text()
    assert run("merge", "--canonical", "dev1@team.example", "--alias", "dev2@team.example") == 0 and "values changed: 0" in capsys.readouterr().out
