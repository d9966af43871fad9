"""Files of token ids in Simple-8b words (Anh and Moffat, "Index compression using 64-bit words").

A 64-bit word holds a selector in its top 4 bits and as many ids as the selector says, each in the
same number of bits, the first lowest. An id of ESCAPE or more is written as ESCAPE and its value
follows, in order, in the block's list of escapes; so 15 bits are the most that an id takes.

A file is Parquet, one row a block of whole documents: the part (files follow each other by part),
the number of ids before the block in its part, the ids of its documents, where each document's
token ids begin in the block (one more for the end), the words and the escapes. A block is decoded
by selector, all words of a selector at once.

Documents are range-partitioned by doc_id and sorted within a part, so the files hold them in
ascending doc_id order (nulls first). Rows that share a doc_id (or have none) follow in the order of
their texts' hashes and then of the input, and these are part of the ranges too: an id that a third of
all rows have spreads over as many parts as others do.
A null or empty text has its end id only; an empty table gives files without rows; other columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from forgelens.llm.slices import by_bytes
from forgelens.llm.tokens import Encoder

# Ids in a word and bits of each, by selector; the largest id that a word holds stands for an escape.
COUNTS = (240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS = (0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
ESCAPE = (1 << 15) - 1

#: A block ends with the document that brings it to so many ids.
BLOCK_IDS = 1 << 16

SCHEMA = "part int, before long, doc_ids array<long>, starts array<int>, words binary, escapes binary"
_NAMES = ("part", "before", "doc_ids", "starts", "words", "escapes")
_U = np.uint64
#: Bits that each value up to ESCAPE takes.
_WIDTH = np.searchsorted(1 << np.arange(16), np.arange(ESCAPE + 1), side="right").astype(np.int8)


def encode(ids: np.ndarray) -> tuple[bytes, bytes]:
    """(words, escapes) of ids below 2 ** 32."""
    n = len(ids)
    over = ids >= ESCAPE
    values = np.where(over, ESCAPE, ids).astype(np.uint64)
    choice = np.full(n, len(COUNTS) - 1, np.int8)
    least = _WIDTH[values]
    for s in range(len(COUNTS) - 2, -1, -1):  # from few to many, so that the most stays
        c = COUNTS[s]
        if c > n:
            break
        wide = np.concatenate([[0], np.cumsum(least > BITS[s], dtype=np.int32)])
        choice[: n - c + 1][wide[c:] == wide[:-c]] = s
    step = memoryview(np.array(COUNTS)[choice])
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i += step[i]
    at = np.array(starts, np.int64)
    selector = choice[at].astype(np.uint64) if n else np.zeros(0, np.uint64)
    words = selector << _U(60)
    for s in np.unique(selector).tolist():
        mine = np.flatnonzero(selector == _U(s))
        for j in range(COUNTS[s] if BITS[s] else 0):
            words[mine] |= values[at[mine] + j] << _U(j * BITS[s])
    return words.astype("<u8").tobytes(), ids[over].astype("<u4").tobytes()


def decode(words: bytes, escapes: bytes) -> np.ndarray:
    """The ids, as unsigned 32-bit integers."""
    w = np.frombuffer(words, "<u8")
    selector = (w >> _U(60)).astype(np.int64)
    ends = np.cumsum(np.array(COUNTS)[selector])
    out = np.zeros(int(ends[-1]) if len(w) else 0, "<u4")
    for s in np.unique(selector).tolist():
        mine = np.flatnonzero(selector == s)
        begin = ends[mine] - COUNTS[s]
        for j in range(COUNTS[s] if BITS[s] else 0):
            out[begin + j] = (w[mine] >> _U(j * BITS[s])) & _U((1 << BITS[s]) - 1)
    out[out == ESCAPE] = np.frombuffer(escapes, "<u4")
    return out


def _blocks(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
    columns = list(zip(*rows)) if rows else [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=list(_NAMES))


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Encodes whole texts, with the end id after each, and writes the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, end = Encoder.of(tokenizer), TaskContext.get().partitionId(), np.array([end_id], "<u4").tobytes()
        before, ids, doc_ids, starts = 0, bytearray(), [], [0]

        def block() -> tuple:
            nonlocal before, ids, doc_ids, starts
            row = (part, before, doc_ids, starts, *encode(np.frombuffer(bytes(ids), "<u4")))
            before, ids, doc_ids, starts = before + starts[-1], bytearray(), [], [0]
            return row

        for b in by_bytes(batches, 1):
            rows = []
            for doc_id, found in zip(b.column(0).to_pylist(), encoder.encode(b.column(1).to_pylist())):
                ids += found + end
                doc_ids.append(doc_id)
                starts.append(len(ids) // 4)
                if starts[-1] >= BLOCK_IDS:
                    rows.append(block())
            yield _blocks(rows)
        if doc_ids:
            yield _blocks([block()])

    text = F.col("text").cast("string")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("at"))
    order = ("doc_id", "h", "at")
    slim.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(run, SCHEMA).write.parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (little-endian unsigned 32-bit) from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                before, doc_ids, starts, words, escapes = (b.column(i)[row].as_py() for i in range(5))
                ids = decode(words, escapes).tobytes()
                pieces = [ids[4 * x : 4 * y] for x, y in zip(starts, starts[1:])]
                at = np.array(starts, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(before + at[:-1]), pa.array(np.diff(at)), pa.array(pieces, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    blocks = spark.read.schema(SCHEMA).parquet(path)
    totals = blocks.groupBy("part").agg(F.max(F.col("before") + F.element_at("starts", -1)).alias("n"))
    offsets = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("earlier"))
    placed = blocks.join(F.broadcast(offsets), "part")  # one row for each part
    return placed.select(F.col("before") + F.col("earlier"), "doc_ids", "starts", "words", "escapes").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def crc_of_ids(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
