"""Vector bin packing of token sequences.

Every document becomes pieces; pieces go into sequences that respect three limits at once: tokens,
segments and loss-bearing tokens. The item for an open sequence is the one with the largest dot
product of its demands and the sequence's residual capacities (Panigrahy et al., "Heuristics for
vector bin packing"), each dimension weighted by the mean demand. When nothing fits whole, the best
item is cut to fill the gap.

Packing happens inside each input partition, in blocks of a bounded number of pieces, so nothing is
shuffled and a lost task repeats by itself. What is left at a partition's end and doesn't fill a
sequence is cut at powers of two, which need no padding.

Defined results: a null or empty text has only its end id (one piece); a document that repeats is
packed once for each row; an empty table gives no pieces; other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgelens.llm.slices import by_bytes
from forgelens.llm.tokens import Encoder

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, loss_tokens long, sequence_id long, offset long"
FIELDS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "loss_tokens", "sequence_id", "offset")


@dataclass(frozen=True)
class Limits:
    """Per sequence; the tokens limit has to be a power of two if no sequence may be padded."""

    tokens: int = 1024
    segments: int = 64
    loss_tokens: int = 1024


@dataclass
class Piece:
    doc_id: int | None
    start: int
    ids: bytes
    no_loss: int
    doc_tokens: int

    def __len__(self) -> int:
        return len(self.ids) // 4

    @property
    def loss(self) -> int:
        return len(self) - self.no_loss

    def cut(self, n: int) -> tuple[Piece, Piece]:
        """The first n ids, and the rest. The ids without loss are a document's first ones."""
        head = min(self.no_loss, n)
        return (
            Piece(self.doc_id, self.start, self.ids[: 4 * n], head, self.doc_tokens),
            Piece(self.doc_id, self.start + n, self.ids[4 * n :], self.no_loss - head, self.doc_tokens),
        )

    def room(self, tokens: int, loss: int) -> int:
        """How many of the first ids fit."""
        return min(len(self), tokens, self.no_loss + loss)


def _powers_of_two(pieces: list[Piece]) -> Iterator[list[Piece]]:
    """Cuts a sequence so that each part's length is a power of two."""
    left = sum(map(len, pieces))
    pieces = pieces[::-1]
    while left:
        size = 1 << (left.bit_length() - 1)
        part, need = [], size
        while need:
            p = pieces.pop()
            if len(p) > need:
                p, rest = p.cut(need)
                pieces.append(rest)
            part.append(p)
            need -= len(p)
        yield part
        left -= size


def fill(pool: list[Piece], limits: Limits, last: bool) -> tuple[list[list[Piece]], list[Piece]]:
    """Full sequences from a block of pieces, and the pieces of the one that isn't full; with last, that one too, cut at powers of two."""
    done: list[list[Piece]] = []
    pool = list(pool)
    limit = np.array([limits.tokens, limits.segments, limits.loss_tokens], float)
    need = np.array([[len(p), 1, p.loss] for p in pool], float).reshape(-1, 3)
    weight = need.mean(axis=0) / limit if len(pool) else limit
    there = np.ones(len(pool), bool)
    share = need / limit * weight
    count = len(pool)
    while count:
        left, sequence = limit.copy(), []
        while count and left[0] and left[1]:
            fit = there & (need[:, 0] <= left[0]) & (need[:, 2] <= left[2])
            whole = fit.any()
            able = fit if whole else there & (np.minimum(left[2], need[:, 2]) + need[:, 0] - need[:, 2] > 0)
            if not able.any():
                break
            i = int(np.argmax(np.where(able, share @ (left / limit), -1.0)))
            p = pool[i]
            if whole:
                there[i], count = False, count - 1
            else:
                p, pool[i] = p.cut(p.room(int(left[0]), int(left[2])))
                need[i] = len(pool[i]), 1, pool[i].loss
                share[i] = need[i] / limit * weight
            sequence.append(p)
            left -= len(p), 1, p.loss
        if left[0] and not count:
            if not last:
                return done, sequence
            done += _powers_of_two(sequence)
        else:
            done.append(sequence)
    return done, []


class Packer:
    """Documents in, sequences out, with a bounded pool of pieces."""

    def __init__(self, limits: Limits, block: int):
        self.limits, self.block, self.pool = limits, block, []

    def add(self, doc: Piece) -> Iterator[list[Piece]]:
        most = self.limits
        while (n := doc.room(most.tokens, most.loss_tokens)) < len(doc):
            piece, doc = doc.cut(n)
            if n == most.tokens:
                yield [piece]
            else:
                self.pool.append(piece)
        if len(doc) == most.tokens:
            yield [doc]
        else:
            self.pool.append(doc)
        if len(self.pool) >= self.block:
            done, self.pool = fill(self.pool, most, False)
            yield from done

    def end(self) -> Iterator[list[Piece]]:
        yield from fill(self.pool, self.limits, True)[0]
        self.pool = []


def pack(docs: DataFrame, tokenizer: str, end_id: int, limits: Limits = Limits(), prompt_col: str | None = None, block: int = 2048) -> DataFrame:
    """Pieces of all documents with their places in sequences.

    docs: needs doc_id and text. prompt_col: a text that stands before each document's own and bears
    no loss (instruction data); without it every id bears loss. block: pieces packed at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = Encoder.of(tokenizer), Packer(limits, block)
        end = np.array([end_id], "<u4").tobytes()
        sequence_id = TaskContext.get().partitionId() << 32

        def rows(sequences: Iterator[list[Piece]]) -> Iterator[tuple]:
            nonlocal sequence_id
            for sequence in sequences:
                offset = 0
                for p in sequence:
                    yield p.doc_id, p.start, len(p), zlib.crc32(p.ids), p.doc_tokens, p.loss, sequence_id, offset
                    offset += len(p)
                sequence_id += 1

        def batch(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found) if found else [[]] * len(FIELDS))], names=list(FIELDS))

        for b in by_bytes(batches, *range(1, 3 if prompt_col else 2)):
            found: list[tuple] = []
            texts = b.column(1).to_pylist()
            prompts = encoder.encode(b.column(2).to_pylist()) if prompt_col else iter([b""] * len(texts))
            for doc_id, prompt, ids in zip(b.column(0).to_pylist(), prompts, encoder.encode(texts)):
                ids = prompt + ids + end
                found += rows(packer.add(Piece(doc_id, 0, ids, len(prompt) // 4, len(ids) // 4)))
            yield batch(found)
        yield batch(list(rows(packer.end())))

    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    return docs.select(*columns, *([F.col(prompt_col).cast("string").alias("prompt")] if prompt_col else [])).mapInArrow(run, SCHEMA)
