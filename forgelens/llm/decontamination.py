"""Benchmark passages in documents, by Wu-Manber multi-pattern search.

Texts become lower-case (A-Z) words of digits, letters and non-ASCII characters, joined by single
spaces. A benchmark item's windows of consecutive words are the patterns, each with a space on either
side, so that an occurrence begins and ends at words. Patterns are put in classes by length; a class
has a block shift table over the first m bytes of its patterns (m: its shortest), which skips
positions where no pattern can end; the block at a zero shift selects a bucket of patterns, and these
are compared directly.

Items go to the executors as segments of their words, in blocks of a bounded number of bytes (checked
by an aggregate first) that workers expand to windows; a worker keeps the tables of its last block for
the tasks that follow. A block is one pass over the documents with one worker a core; where there are
several blocks, each pass is written before the next, so no worker ever holds two. Nothing is
shuffled but the rows with hits of several blocks.

Defined results: a null or empty text, or one of separators only, has no words and no hits; an item
without words has no window; an item without an id marks words but isn't listed; items and documents
may repeat (an item id counts once); without any items every document is clean.
"""

from __future__ import annotations

import uuid
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgelens.llm.slices import by_bytes
from forgelens.llm.tables import cut

#: Bytes of a block in the shift tables, lengths at which a new class begins, bytes of a block's windows, windows of a segment.
BLOCK, CLASSES, WINDOW_BYTES, SEGMENT = 8, (8, 16, 32), 32 << 20, 1000

_AS_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
SCHEMA = "doc_id long, h long, n_words long, hits array<struct<start:int,end:int>>, items array<string>"
_HITS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(_AS_WORDS).split() if text else []


def joined(found: list[bytes]) -> bytes:
    return b" " + b" ".join(found) + b" "


class ShiftTable:
    """Wu-Manber tables of patterns of similar lengths. patterns: bytes -> anything."""

    def __init__(self, patterns: dict[bytes, object]):
        self.patterns, self.m = patterns, min(map(len, patterns))
        self.block = min(BLOCK, self.m)
        self.most = self.m - self.block + 1
        self.shift: dict[bytes, int] = {}
        self.bucket: dict[bytes, list[bytes]] = {}
        for p in patterns:
            for end in range(self.block, self.m + 1):
                key = p[end - self.block : end]
                self.shift[key] = min(self.shift.get(key, self.most), self.m - end)
            self.bucket.setdefault(p[self.m - self.block : self.m], []).append(p)

    def occurrences(self, text: bytes) -> Iterator[tuple[int, bytes]]:
        """(start, pattern), by start."""
        end, n, size, most, shift = self.m, len(text), self.block, self.most, self.shift.get
        while end <= n:
            key = text[end - size : end]
            skip = shift(key, most)
            if not skip:
                start = end - self.m
                for p in self.bucket[key]:
                    if text.startswith(p, start):
                        yield start, p
                skip = 1
            end += skip


class Patterns:
    """Windows with their items, in classes by length."""

    def __init__(self, windows: list[tuple[bytes, str | None]]):
        by: list[dict[bytes, set[str]]] = [{} for _ in range(len(CLASSES) + 1)]
        for w, item in windows:
            of = by[bisect_right(CLASSES, len(w))].setdefault(bytes(w), set())
            if item is not None:
                of.add(item)
        self.tables = [ShiftTable(x) for x in by if x]

    def find(self, text: bytes) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit words as disjoint ranges, and the items with occurring windows."""
        ranges: list[tuple[int, int]] = []
        items: set[str] = set()
        for t in self.tables:
            at = word = 0
            for start, p in t.occurrences(text):
                word += text.count(b" ", at, start)
                at = start
                ranges.append((word, word + p.count(b" ") - 1))
                items |= t.patterns[p]
        return merged(ranges), items


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((start, end))
    return out


Segment = tuple[str, str | None]
_kept: dict[str, Patterns] = {}


def segments(benchmark: DataFrame, length: int) -> DataFrame:
    """Distinct (words, item): runs of an item's words that hold each of its windows once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, 1):
            rows = []
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = words(text)
                rows += [(b" ".join(found[i : i + SEGMENT + length - 1]), item) for i in range(0, max(1, len(found) - length + 1) if found else 0, SEGMENT)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0].decode() for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], names=["words", "item"])

    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    return items.mapInArrow(run, "words string, item string").distinct()


def blocks_of(found: DataFrame, length: int) -> Iterator[list[Segment]]:
    """The segments in blocks whose windows have at most about WINDOW_BYTES, one after another."""
    size = (found.agg(F.sum(F.octet_length("words") + F.coalesce(F.octet_length("item"), F.lit(0)) + 1)).first()[0] or 0) * length
    blocks = -(-size // WINDOW_BYTES) or 1
    for i in range(blocks):
        block = found if blocks == 1 else found.filter(F.pmod(F.xxhash64("words", "item"), F.lit(blocks)) == i)
        yield [(r[0], r[1]) for r in block.collect()]


def _tables(sent: tuple[str, list[Segment]], length: int) -> Patterns:
    """A block's patterns, made once by each worker."""
    name, block = sent
    if name not in _kept:
        _kept.clear()
        _kept[name] = Patterns([(joined(w[i : i + length]), item) for text, item in block for w in [text.encode().split()] for i in range(max(1, len(w) - length + 1))])
    return _kept[name]


def _sent(frame: DataFrame, block: list[Segment]):
    return frame.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, block))


def _pass(docs: DataFrame, block: list[Segment], length: int) -> DataFrame:
    """Hits and items of one block; h: the text's hash."""
    sent = _sent(docs, block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _tables(sent.value, length)
        for b in by_bytes(batches, 1):
            n_words, hits, items = [], [], []
            for text in b.column(1).to_pylist():
                w = words(text)
                ranges, found = tables.find(joined(w))
                n_words.append(len(w))
                hits.append([{"start": s, "end": e} for s, e in ranges])
                items.append(sorted(found))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n_words, pa.int64()), pa.array(hits, _HITS), pa.array(items, pa.list_(pa.string()))], names=["doc_id", "h", "n_words", "hits", "items"])

    text = docs["text"].cast("string")
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h")).mapInArrow(run, SCHEMA)


def _together(found: DataFrame) -> DataFrame:
    """One row for each document of several blocks' rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits = [[{"start": s, "end": e} for s, e in merged([(x["start"], x["end"]) for x in row])] for row in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(hits, _HITS), b.column(3)], names=["doc_id", "h", "hits", "items"])

    rows = found.groupBy("doc_id", "h").agg(F.flatten(F.collect_set("hits")).alias("hits"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    return rows.mapInArrow(run, SCHEMA.replace("n_words long, ", ""))


def find_overlaps(docs: DataFrame, benchmark: DataFrame, length: int = 10) -> DataFrame:
    """Per document its number of words, the ranges of words inside occurring windows and the items that they belong to."""
    first, others = None, None
    for block in blocks_of(cut(segments(benchmark, length)), length):
        if first is None:
            first = _pass(docs, block, length)
            continue
        more = cut(_pass(docs, block, length).filter(F.size("hits") > 0).drop("n_words"))
        others = more if others is None else others.unionByName(more)
    if others is None:
        return first.drop("h")
    first = cut(first)
    together = _together(others.unionByName(first.filter(F.size("hits") > 0).drop("n_words")))
    rows = first.drop("hits", "items").join(together.withColumnRenamed("doc_id", "id"), F.col("doc_id").eqNullSafe(F.col("id")) & (first["h"] == together["h"]), "left")
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    return rows.select("doc_id", "n_words", none("hits", "array<struct<start:int,end:int>>"), none("items", "array<string>"))


def digest(found: DataFrame) -> DataFrame:
    """Counts of hit words and items, with a digest of the item ids sorted as strings."""
    return found.select(
        "doc_id", "n_words", F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["end"] - h["start"]).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )


def _without(docs: DataFrame, block: list[Segment], length: int) -> DataFrame:
    sent, at = _sent(docs, block), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _tables(sent.value, length)
        for b in by_bytes(batches, at):
            yield b.filter(pa.array([not tables.find(joined(words(t)))[0] for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, length: int = 10) -> DataFrame:
    """Documents without any hit, with all their columns (text has to be a string)."""
    left = None
    for block in blocks_of(cut(segments(benchmark, length)), length):
        left = _without(docs if left is None else cut(left), block, length)
    return left
