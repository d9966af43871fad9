"""Small results as text: Markdown tables, CSV, JSON, a titled report."""

from __future__ import annotations

import csv
import datetime as dt
import io
import json
from collections.abc import Callable

from pyspark.sql import DataFrame


_SHOWN: dict[type, Callable[[object], str]] = {
    dt.datetime: lambda v: v.date().isoformat(), dt.date: lambda v: v.isoformat(), float: lambda v: format(v, ",.2f") if abs(v) >= 100 else repr(v),
}


def shown(value: object) -> str:
    """A dash for null, days for times, thousands for large floats, other floats in full."""
    return "-" if value is None else _SHOWN.get(type(value), str)(value)


def markdown(result: DataFrame) -> str:
    """For results of a few rows, which it collects."""
    found = result.collect()
    if not found:
        return "_No data._"
    rows = [result.columns, ["---"] * len(result.columns), *[[shown(v) for v in r] for r in found]]
    return "\n".join("| " + " | ".join(r) + " |" for r in rows)


def as_csv(result: DataFrame) -> str:
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(result.columns)
    writer.writerows([["" if v is None else v for v in r] for r in result.collect()])
    return out.getvalue()


def as_json(result: DataFrame) -> str:
    return json.dumps([r.asDict() for r in result.collect()], indent=1, default=str)


FORMATS = {"table": markdown, "csv": as_csv, "json": as_json}


def report(title: str, period: tuple[str, str], results: dict[str, DataFrame], top: int = 10) -> str:
    """Sections in the order given; the authors' table has the first ones only."""
    parts = [f"# {title}", f"From {period[0]} to {period[1]} (exclusive)."]
    for name, result in results.items():
        parts += [f"## {name.replace('_', ' ').capitalize()}", markdown(result.limit(top) if name.startswith("author") else result)]
    return "\n\n".join(parts) + "\n"
