"""Archives: what is written is what is read, in files that say what they hold."""

import gzip
import hashlib
import json
import random
import urllib.parse
from pathlib import Path

import pytest

from forgelens.llm import warc

PAGES = "page_id long, url string, html string"


def brute(rows, least=1000):
    payloads = [(i, (h or "").encode()) for i, _, h in rows]
    owner = {}
    for i, p in payloads:
        owner[p] = max(owner.get(p, (False, 0)), (i is not None, i or 0))
    out, taken = [], set()
    for i, p in payloads:
        best = owner[p][1] if owner[p][0] else None
        first = len(p) < least or (i == best and p not in taken)
        if len(p) >= least and first:
            taken.add(p)
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "response" if first else "revisit", None if first else best))
    return out


def key(r):
    return [(x is not None, str(x)) for x in r]


def rows_of(found):
    return sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found.collect()), key=key)


def pages(rng, n):
    long = ["<p>" + " ".join(rng.choice(["näm", "word", "x"]) for _ in range(rng.randrange(200, 900))) + "</p>" for _ in range(n // 3)]
    rows = [(i, f"http://h{i % 7}.example/{i}?q=ä b", rng.choice([*long, "short", "", None])) for i in range(n)]
    return rows + [(n + i, "http://copies.example/", long[0]) for i in range(n // 2)]


@pytest.mark.parametrize(("hot_part", "roll"), [(500, 64 << 20), (5, 3000), (10**9, 500)])
def test_archives(spark, monkeypatch, tmp_path, hot_part, roll):
    """With payloads of many copies apart, or none, or all; in one file a shard, or many."""
    monkeypatch.setattr(warc, "HOT_PART", hot_part)
    rows = pages(random.Random(roll), 90)
    rows += [rows[5], rows[-1], rows[-1], (None, None, rows[-1][2]), (None, "u", "z" * 1500), (None, "v", "z" * 1500)]  # repeated, and without numbers
    table = spark.createDataFrame(rows, PAGES)
    path = f"file://{tmp_path}/a"
    warc.write_warc(table.repartition(3), path, roll_bytes=roll, shards=4)
    assert rows_of(warc.read_warc(spark, path)) == sorted(brute(rows), key=key)
    whole = warc.read_warc(spark, path, payload=True).collect()
    html = {(r["payload_digest"]): r["html"] for r in whole if r["record_type"] == "response"}
    assert all(hashlib.sha1(h.encode()).hexdigest() == d for d, h in html.items())
    assert {urllib.parse.unquote(r["url"]) for r in whole if r["url"]} == {u for _, u, _ in rows if u}
    manifest = [r.asDict() for r in spark.read.parquet(f"{path}/manifest").collect()]
    files = {f.name: f.read_bytes() for f in (tmp_path / "a/archive").iterdir() if not f.name.startswith(".")}  # .crc files of none
    assert {m["file"] for m in manifest} == set(files) and sum(m["records"] for m in manifest) == len(rows)
    assert all(len(files[m["file"]]) == m["bytes"] and hashlib.sha256(files[m["file"]]).hexdigest() == m["sha256"] for m in manifest)
    ids, refers = [], []
    for name, data in files.items():
        whole_file = gzip.decompress(data).decode()
        assert whole_file.startswith("WARC/1.1\r\n") and f"WARC-Filename: {name}\r\n" in whole_file
        ids += [x.split("\r\n")[0] for x in whole_file.split("WARC-Record-ID: ")[1:]]
        refers += [x.split("\r\n")[0] for x in whole_file.split("WARC-Refers-To: ")[1:]]
    assert len(set(ids)) == len(ids) == len(rows) + len(files) and set(refers) <= set(ids)
    assert (max(m["records"] for m in manifest) < 30) == (roll < 10_000)
    again = f"file://{tmp_path}/b"
    warc.write_warc(table.repartition(7), again, roll_bytes=roll, shards=4)
    assert {f.name: f.read_bytes() for f in (tmp_path / "b/archive").iterdir()} == files  # nothing depends on how the rows came


def test_archives_of_odd_pages(spark, messy, tmp_path):
    table = messy.withColumnRenamed("doc_id", "page_id").withColumnRenamed("text", "html").withColumnRenamed("lang", "url")
    warc.write_warc(table, f"file://{tmp_path}/odd", shards=3)
    assert rows_of(warc.read_warc(spark, f"file://{tmp_path}/odd")) == sorted(brute([(r["page_id"], r["url"], r["html"]) for r in table.collect()]), key=key)
    warc.write_warc(table.limit(0), f"file://{tmp_path}/none")
    assert warc.read_warc(spark, f"file://{tmp_path}/none").collect() == []


def test_broken_archives_are_refused(spark, tmp_path):
    """A record whose bytes changed; a file that lacks its end; leftovers of attempts don't count."""
    path = f"file://{tmp_path}/x"
    warc.write_warc(spark.createDataFrame([(1, "http://a", "y" * 2000), (2, "http://b", "z" * 2000)], PAGES), path, shards=1)
    folder = Path(tmp_path / "x/archive")
    (folder / "_attempt-pages.warc.gz").write_bytes(b"half a file")
    assert warc.read_warc(spark, path).count() == 2
    (file,) = folder.glob("pages-*")
    good = file.read_bytes()
    file.write_bytes(good[:-9])
    with pytest.raises(Exception, match="as the manifest has it"):
        warc.read_warc(spark, path).collect()
    member = warc.record([("WARC-Type", "resource")], b"abc")
    assert warc.parsed(gzip.decompress(member))[1] == b"abc"
    with pytest.raises(ValueError, match="broken record"):
        warc.parsed(gzip.decompress(member).replace(b"abc", b"abd"))


def test_failed_attempts_leave_no_file(tmp_path):
    files = warc.Files(f"file://{tmp_path}", 0, "1970-01-01T00:00:00Z", 1 << 20)
    files.add(b"x")
    files.drop()
    assert list(tmp_path.iterdir()) == [] and json.dumps(files.done) == "[]"
