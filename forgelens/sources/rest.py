"""REST pages of a forge as a Spark data source: ``spark.read.format("forge")``, and as a stream: ``spark.readStream.format("forge")``.

Options: repos (comma-joined), base_url, token_env, and transport (module:function, for tests), a
function of a URL and headers that returns (status, headers, body). One partition a repository; a quota is for a token, so read
with no more tasks at a time than the quota bears.
"""

from __future__ import annotations

import datetime as dt
import importlib
import json
import os
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

Transport = Callable[[str, dict], tuple[int, dict, str]]
ATTEMPTS, PAGE, LOW_QUOTA = 5, 100, 100

# Seconds between two requests with one token, by provider (5000 an hour, 1800 a minute), and the quota's headers.
SPACING = {"github": 0.72, "gitlab": 0.033}
QUOTA = {"remaining": ("x-ratelimit-remaining", "ratelimit-remaining"), "reset": ("x-ratelimit-reset", "ratelimit-reset")}


class Spaced:
    """A transport whose requests begin at least so many seconds after one another."""

    def __init__(self, transport: Transport, seconds: float, sleep: Callable[[float], None] = time.sleep, now: Callable[[], float] = time.monotonic):
        self.transport, self.seconds, self.sleep, self.now, self.next = transport, seconds, sleep, now, 0.0

    def __call__(self, url: str, headers: dict) -> tuple[int, dict, str]:
        early = self.next - self.now()
        if early > 0:
            self.sleep(early)
        self.next = self.now() + self.seconds
        return self.transport(url, headers)


def _number(headers: dict, what: str) -> float | None:
    for name in QUOTA[what]:
        try:
            return float(headers[name])
        except (KeyError, ValueError):
            continue
    return None


def http(url: str, headers: dict) -> tuple[int, dict, str]:
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=30) as r:
            return r.status, {k.lower(): v for k, v in r.headers.items()}, r.read().decode()
    except urllib.error.HTTPError as e:
        return e.code, {k.lower(): v for k, v in e.headers.items()}, e.read().decode(errors="replace")


def fetch(url: str, headers: dict, transport: Transport, sleep: Callable[[float], None] = time.sleep, now: Callable[[], float] = time.time, attempts: int = ATTEMPTS) -> tuple[dict, str] | None:
    """A page with retries; None if there is nothing (404, 409)."""
    for attempt in range(attempts):
        try:
            status, got, body = transport(url, headers)
        except OSError:
            sleep(5 * 2**attempt)
            continue
        if status in (404, 409):
            return None
        if status < 400:
            left, reset = _number(got, "remaining"), _number(got, "reset")
            if left is not None and left < LOW_QUOTA and reset is not None:
                sleep(max(0.0, reset - now()))
            return got, body
        if status == 429:
            sleep(float(got.get("retry-after", 60)))
        elif status == 403 and _number(got, "reset") is not None:
            sleep(max(0.0, _number(got, "reset") - now()))
        else:
            sleep(2**attempt)
    raise RuntimeError(f"no answer from {url} after {attempts} attempts")


def pages(url: str, headers: dict, transport: Transport, enough: Callable[[list], bool] | None = None, **how: object) -> Iterator[list]:
    """All pages (a single object counts as a page of one): by the link to the next, by X-Next-Page, or until one is short, or is the first of which enough says so."""
    page = 1
    join = "&" if "?" in url else "?"
    following: str | None = f"{url}{join}per_page={PAGE}&page=1"
    while following:
        found = fetch(following, headers, transport, **how)
        if found is None:
            return
        got, body = found
        rows = json.loads(body)
        if isinstance(rows, dict):  # one object instead of a list
            yield [rows]
            return
        yield rows
        if enough and enough(rows):
            return
        link = re.search(r'<([^>]+)>;\s*rel="next"', got.get("link", ""))
        if link:
            following = link[1]
        elif got.get("x-next-page") or ("link" not in got and "x-next-page" not in got and len(rows) == PAGE):
            page = int(got.get("x-next-page") or page + 1)
            following = f"{url}{join}per_page={PAGE}&page={page}"
        else:
            following = None


def transport_of(name: str, seconds: float = 0.0) -> Transport:
    """module:function, or the network's own; with at least so many seconds between requests."""
    module, _, attribute = name.partition(":")
    found = getattr(importlib.import_module(module), attribute) if module else http
    return Spaced(found, seconds) if seconds else found


def headers_of(token_env: str) -> dict[str, str]:
    token = os.environ.get(token_env, "") if token_env else ""
    return {"Authorization": f"Bearer {token}"} if token else {}


def before(day: str | None) -> Callable[[list], bool] | None:
    """Whether the last of rows, the newest first, was updated before a time (ISO text, compared as far as it goes)."""
    return (lambda rows: bool(rows) and str(rows[-1].get("updated_at") or day)[: len(day)] < day) if day else None


def fetched(asked: DataFrame, base_url: str, token_env: str = "", transport: str = "", tasks: int = 8, seconds: float = 0.0, attempts: int = ATTEMPTS) -> DataFrame:
    """The columns of asked, with pos and body of each object below its path, and one row a path without pos: with the error that ended it, or none. Write the result before reading it twice: each reading asks again.

    A path that fails has no other row, and ends nothing but itself. A column enough_before, if there is one, ends the pages of
    a path at the first whose last object was updated before it. tasks bounds the calls at a time; each task waits tasks times the
    seconds between two, so that the token's quota holds.
    """
    names = asked.columns
    at, until = names.index("path"), names.index("enough_before") if "enough_before" in names else None
    schema = T.StructType([*asked.schema, T.StructField("pos", T.IntegerType()), T.StructField("body", T.StringType()), T.StructField("error", T.StringType())])
    base = base_url.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask, headers = transport_of(transport, seconds * tasks), headers_of(token_env)
        for b in batches:
            enough = b.column(until).to_pylist() if until is not None else [None] * b.num_rows
            for i, path in enumerate(b.column(at).to_pylist()):
                bodies: list[str] = []
                error = None
                try:
                    for page in pages(base + path, headers, ask, before(enough[i]), attempts=attempts):
                        bodies += map(json.dumps, page)
                except Exception as e:  # noqa: BLE001 - whatever a forge answers, other paths go on
                    bodies, error = [], f"{type(e).__name__}: {e}"[:1000]
                n = len(bodies) + 1
                kept = b.take(pa.array([i] * n, pa.int32()))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array([None, *range(n - 1)], pa.int32()), pa.array([None, *bodies], pa.string()), pa.array([error] + [None] * (n - 1), pa.string())], names=[*names, "pos", "body", "error"])

    return asked.repartition(tasks).mapInArrow(run, schema)


class Repo(InputPartition):
    def __init__(self, repo: str):
        super().__init__(repo)
        self.repo = repo


class ForgeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)

    def partitions(self) -> list[Repo]:
        return [Repo(r.strip()) for r in self.options.get("repos", "").split(",") if r.strip()]

    def read(self, partition: Repo) -> Iterator[tuple]:
        o = self.options
        transport, headers = transport_of(o.get("transport", ""), float(o.get("seconds", 0))), headers_of(o.get("token_env", ""))
        url = o["base_url"].rstrip("/") + o.get("path", "/repos/{repo}/commits").replace("{repo}", partition.repo)
        at = 0
        for rows in pages(url, headers, transport):
            for row in rows:
                yield partition.repo, at, json.dumps(row)
                at += 1


class Span(InputPartition):
    """What a repository has listed after one time and up to another."""

    def __init__(self, repo: str, after: str, upto: str):
        super().__init__(repo)
        self.repo, self.after, self.upto = repo, after, upto


def _hours_before(time_: str, hours: float) -> str:
    if not hours or not time_:
        return time_
    return (dt.datetime.fromisoformat(time_) - dt.timedelta(hours=hours)).astimezone(dt.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


class ForgeStreamReader(DataSourceStreamReader):
    """The offset is the time, in UTC, of each repository's newest object; a batch is what lies behind the last offset, up to the next.

    The checkpoint has the offsets, so a query that is begun again lists what its last batch hasn't, and a batch that is
    tried again lists the same. Options beside the reader's: date (where an object has its time, commit.committer.date),
    since (where a new query begins), overlap_hours (listed again before each batch, for objects that came late; what
    they bring twice is for the sink to leave out, as streaming.ingest does).
    """

    def __init__(self, options: dict):
        self.options = dict(options)
        self.repos = [p.repo for p in ForgeReader(options).partitions()]

    def _date(self, row: dict) -> str:
        found: object = row
        for part in self.options.get("date", "commit.committer.date").split("."):
            found = found.get(part) if isinstance(found, dict) else None
        return dt.datetime.fromisoformat(str(found)).astimezone(dt.UTC).strftime("%Y-%m-%dT%H:%M:%SZ") if found else ""

    def _pages(self, repo: str, more: str = "") -> Iterator[list]:
        o = self.options
        path = o.get("path", "/repos/{repo}/commits").replace("{repo}", repo)
        url = o["base_url"].rstrip("/") + path + (("&" if "?" in path else "?") + more if more else "")
        return pages(url, headers_of(o.get("token_env", "")), transport_of(o.get("transport", ""), float(o.get("seconds", 0))))

    def initialOffset(self) -> dict:  # noqa: N802 - Spark's name
        return {r: self.options.get("since", "") for r in self.repos}

    def latestOffset(self) -> dict:  # noqa: N802
        """By the first page of each repository, which has the newest."""
        return {r: max((self._date(row) for row in next(self._pages(r), [])), default="") for r in self.repos}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        return [Span(r, start.get(r, ""), upto) for r, upto in end.items() if upto > start.get(r, "")]

    def read(self, partition: Span) -> Iterator[tuple]:
        hours = float(self.options.get("overlap_hours", 0))
        after = _hours_before(partition.after, hours)
        at = 0
        for rows in self._pages(partition.repo, "&".join([f"since={after}"] * bool(after) + [f"until={partition.upto}"])):
            for row in rows:
                date = self._date(row)
                if (after <= date if hours else after < date) and date <= partition.upto:
                    yield partition.repo, at, json.dumps(row)
                    at += 1


class ForgeSource(DataSource):
    """Rows (repo, pos, body): parse body with from_json and a schema of sources.forge."""

    @classmethod
    def name(cls) -> str:
        return "forge"

    def schema(self) -> str:
        return "repo string, pos int, body string"

    def reader(self, schema) -> ForgeReader:
        return ForgeReader(self.options)

    def streamReader(self, schema) -> ForgeStreamReader:  # noqa: N802 - Spark's name
        return ForgeStreamReader(self.options)
