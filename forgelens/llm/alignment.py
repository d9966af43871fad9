"""Alignment of two tokenizers' tokens over the same bytes.

Each byte of a text gets a label: no token ends there, one of A does, one of B does, or both do. A
regular expression scans the label string for the spans up to each "both"; how many ends of A and of B
a span holds says which tokens form the group. Two tokens are linked if their bytes overlap, which
is once for every stretch between neighbouring ends of either kind.

A pair of ids counts in how many documents it is linked. Documents are worked on in units of a bounded
number of bytes: a unit keeps its links as sorted arrays, once for each pair and document, and is
written as one row. Only the distinct pairs of a unit are shuffled: summed by pair, compared with the
most of their A id (a row for each id of the vocabulary, broadcast), and brought back to their unit,
where every document's sums are made. So no row is made for a link, a pair that every document holds
has one row a unit, and nothing larger than a unit meets in one place.

Both tokenizers end a token before a space that follows something other than white space, whatever
stands around (checked against the vocabulary of B), so a text is cut there, and each distinct piece
of it is encoded, labelled and scanned once by a worker as long as it is kept.

Defined results: a text that is null, empty, or that one of the tokenizers doesn't give back has no
tokens (zeros, and '' for the digest) and no pairs; rows that repeat or share an id are documents of
their own; an empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from forgelens.llm.slices import by_bytes
from forgelens.llm.tables import cut
from forgelens.llm.tokens import byte_letters

#: Bytes of texts in a unit, about (one longer text is a unit alone); pieces that a worker keeps, and how long they may be; rows of pairs in a batch.
UNIT_BYTES, KEEP_PIECES, KEEP_CHARS, PAIR_ROWS = 8 << 20, 600_000, 48, 200_000

UNIT = "unit long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, groups_sha256 array<string>, pairs binary, holders binary, docs binary, times binary"
PAIR = "unit long, a int, b int, holders long"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_SCALARS = ("n_a", "n_b", "n_groups")

#: Ends up to and with one of both kinds, in a string of labels: 0 none, 1 A's, 2 B's, 3 both.
_SPAN = re.compile(rb"[^\x03]*\x03")
_PIECES = re.compile(r"(?<=\S)(?= )")

#: n_a, n_b, n_groups, the groups as text, and a pair of ids for each link.
Aligned = tuple[int, int, int, str, bytes]


def labels(a: np.ndarray, b: np.ndarray, n: int) -> bytes:
    """The label of each of n bytes, of the ends of tokens."""
    out = np.zeros(n, np.uint8)
    out[a - 1] |= 1
    out[b - 1] |= 2
    return out.tobytes()


def group_ends(label: bytes) -> np.ndarray:
    """Where the spans end."""
    return np.cumsum(np.fromiter(map(len, _SPAN.findall(label)), np.int64))


class Aligner:
    """Two tokenizers: A as a file of ``tokenizers``, B as a model of ``sentencepiece``. Strings of special tokens are plain text."""

    _open: dict[tuple[str, str], Aligner] = {}

    def __init__(self, a: str, b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a), SentencePieceProcessor(model_file=b)
        self.a.encode_special_tokens = True
        letters = {chr(c): byte for byte, c in byte_letters().items()}
        with open(a, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        self.a_bytes = [b""] * (1 + max(vocabulary.values()))
        for entry, i in vocabulary.items():
            self.a_bytes[i] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else b""
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.may_cut = not any("▁" in p.lstrip("▁") for p in pieces)
        self.blank = self.b.piece_to_id("▁")
        self.size = len(pieces)
        self.lengths = [np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes)]
        # ids as text with what stands behind them inside a group and at its end
        self.shown = [[np.array([f"{i}{mark}" for i in range(len(x))], object) for mark in marks] for x, marks in ((self.a_bytes, ",|"), (self.b_bytes, ",;"))]
        self.kept: dict[str, Aligned | None] = {}

    @classmethod
    def of(cls, a: str, b: str) -> Aligner:
        """The worker's aligner of these files."""
        if (a, b) not in cls._open:
            cls._open[a, b] = cls(a, b)
        return cls._open[a, b]

    def _learn(self, pieces: list[str]) -> dict[str, Aligned | None]:
        """Of pieces that begin with a space each; None where a tokenizer doesn't give the piece's bytes."""
        found = [x.ids for x in self.a.encode_batch_fast(pieces, add_special_tokens=False)], [y or [self.blank] for y in self.b.encode([p[1:] for p in pieces], num_threads=1)]  # B adds the space again
        texts = [p.encode() for p in pieces]
        if not all(self._gives(ids, which, texts) for which, ids in enumerate(found)):
            good = [all(self._gives([ids[i]], which, [t]) for which, ids in enumerate(found)) for i, t in enumerate(texts)]
            kept = [i for i, ok in enumerate(good) if ok]
            whole = self._aligned([texts[i] for i in kept], *[[ids[i] for i in kept] for ids in found])
            return {p: next(whole) if ok else None for p, ok in zip(pieces, good)}
        return dict(zip(pieces, self._aligned(texts, *found)))

    def _gives(self, ids: list[list[int]], which: int, texts: list[bytes]) -> bool:
        """Whether the tokens' bytes are those of each text."""
        parts = (self.a_bytes, self.b_bytes)[which]
        if b"".join([parts[i] for x in ids for i in x]) != b"".join(texts):
            return False
        n, length = np.fromiter(map(len, ids), np.int64, len(ids)), self.lengths[which]
        ends = np.cumsum(length[np.fromiter(chain.from_iterable(ids), np.int64)])
        return bool((ends[np.cumsum(n) - 1] == np.cumsum([len(t) for t in texts])).all()) and bool(n.all())

    def _aligned(self, texts: list[bytes], *found: list[list[int]]) -> Iterator[Aligned]:
        """Of texts that both tokenizers give back, all in one string of labels; every text ends with a label of both."""
        if not texts:
            return
        ids = [np.fromiter(chain.from_iterable(x), np.int64) for x in found]
        ends = [np.cumsum(length[x]) for length, x in zip(self.lengths, ids)]
        label = labels(*ends, int(ends[0][-1]))
        upto = group_ends(label)
        # how many ends of each kind a span has, as sums up to its end
        counts = [np.searchsorted(e, upto, "right") for e in ends]
        flat = np.frombuffer(label, np.uint8)
        at = np.flatnonzero(flat)
        kinds = [flat[at] & 1, flat[at] >> 1]
        a, b = (x[np.cumsum(k, dtype=np.int64) - k] for x, k in zip(ids, kinds))  # the tokens of each stretch
        links = (a * self.size + b).astype("<i8").tobytes()
        tokens = np.empty(len(ids[0]) + len(ids[1]), object)
        for which, (x, (inside, last)) in enumerate(zip(ids, self.shown)):
            text = inside[x]
            text[counts[which] - 1] = last[x[counts[which] - 1]]
            others = np.repeat(counts[1 - which] if which else np.concatenate([[0], counts[1][:-1]]), np.diff(counts[which], prepend=0))
            tokens[np.arange(len(x)) + others] = text
        tokens = tokens.tolist()
        n = [np.cumsum([len(y) for y in x]) for x in found]
        last = np.searchsorted(upto, np.cumsum([len(t) for t in texts])) + 1
        before = (0, 0, 0)
        for now in zip(n[0].tolist(), n[1].tolist(), last.tolist()):
            (x, y, g), (i, j, k) = before, now
            yield i - x, j - y, k - g, "".join(tokens[x + y : i + j])[:-1], links[8 * (x + y - g) : 8 * (i + j - k)]
            before = now

    def align(self, texts: list[str | None]) -> Iterator[Aligned | None]:
        """None for a text without tokens."""
        cut_ = [(_PIECES.split(" " + t) if self.may_cut else [" " + t]) if t else [] for t in texts]
        if len(self.kept) > KEEP_PIECES:
            self.kept.clear()
        kept = self.kept
        learnt = self._learn(list({p for pieces in cut_ for p in pieces}.difference(kept)))
        long = {p: x for p, x in learnt.items() if len(p) > KEEP_CHARS}
        kept.update(learnt if not long else {p: x for p, x in learnt.items() if p not in long})
        for pieces in cut_:
            found = [long[p] if p in long else kept[p] for p in pieces]
            if not found or None in found:
                yield None
            else:
                a, b, n, shown, pairs = zip(*found)
                yield sum(a), sum(b), sum(n), ";".join(shown), b"".join(pairs)


def _packed(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.tobytes())


def _unpacked(x: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind)


def units(docs: DataFrame, a: str, b: str) -> DataFrame:
    """Documents in units with their links: sorted pairs, how many documents hold each, and for each pair these (their place in the unit) with how many times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, unit = Aligner.of(a, b), TaskContext.get().partitionId() << 33
        for whole in by_bytes(batches, 1, limit=UNIT_BYTES):
            ids, scalars, shas, links, ends = whole.column(0).to_pylist(), {k: [] for k in _SCALARS}, [], [], []
            for part in by_bytes(iter([whole]), 1):
                for found in aligner.align(part.column(1).to_pylist()):
                    for k, n in zip(_SCALARS, found or (0, 0, 0)):
                        scalars[k].append(n)
                    shas.append(hashlib.sha256(found[3].encode()).hexdigest() if found else "")
                    links.append(found[4] if found else b"")
                    ends.append(len(links[-1]) // 8)
            flat = np.frombuffer(b"".join(links), "<i8")
            del links
            each, times = np.unique(flat * len(ids) + np.repeat(np.arange(len(ids)), ends), return_counts=True)
            of = each // len(ids)
            pairs, holders = np.unique(of, return_counts=True)
            arrays = (pairs.astype("<i8"), holders.astype("<u4"), (each - of * len(ids)).astype("<u4"), times.astype("<u4"))
            row = {"unit": unit, "doc_id": ids, **scalars, "groups_sha256": shas, **dict(zip(("pairs", "holders", "docs", "times"), map(_packed, arrays)))}
            yield pa.RecordBatch.from_pylist([row], schema=_UNIT)
            unit += 1

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, UNIT)


_LONGS = pa.list_(pa.int64())
_UNIT = pa.schema([("unit", pa.int64()), ("doc_id", _LONGS), *[(k, _LONGS) for k in _SCALARS], ("groups_sha256", pa.list_(pa.string())), *[(k, pa.binary()) for k in ("pairs", "holders", "docs", "times")]])


def unit_pairs(made: DataFrame, size: int) -> DataFrame:
    """A row for each unit and pair: how many of its documents hold it. size: of B's vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for i in range(x.num_rows):
                unit, pairs, holders = x.column(0)[i].as_py(), _unpacked(x.column(1)[i].as_py(), "<i8"), _unpacked(x.column(2)[i].as_py(), "<u4")
                for at in range(0, len(pairs), PAIR_ROWS):
                    p = pairs[at : at + PAIR_ROWS]
                    columns = np.full(len(p), unit), (p // size).astype(np.int32), (p % size).astype(np.int32), holders[at : at + PAIR_ROWS].astype(np.int64)
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], names=["unit", "a", "b", "holders"])

    return made.select("unit", "pairs", "holders").mapInArrow(run, PAIR)


def counted(pairs: DataFrame) -> DataFrame:
    """The pairs of units with the corpus-wide count c of each, and whether it is the most of its A id."""
    summed = cut(pairs.withColumn("c", F.sum("holders").over(Window.partitionBy("a", "b"))).select("unit", "a", "b", "c"))
    most = summed.groupBy("a").agg(F.max("c").alias("most"))
    return summed.join(F.broadcast(most), "a").select("unit", "a", "b", "c", (F.col("c") == F.col("most")).alias("best"))  # a row for each id of A's vocabulary


def align(docs: DataFrame, a: str, b: str) -> DataFrame:
    """Per document n_a, n_b, n_groups, n_links, n_best (links whose pair counts as much as any of its A id), count_sum (over links) and groups_sha256."""
    made = cut(units(docs, a, b))
    size = Aligner.of(a, b).size

    def sums(key: tuple, of: pa.Table, counts: pa.Table) -> pa.Table:
        row = of.to_pylist()[0]
        n = len(row["doc_id"])
        code = counts.column("a").to_numpy().astype(np.int64) * size + counts.column("b").to_numpy()
        order = np.argsort(code)  # as the unit's own pairs are sorted
        holders, docs_, times = (_unpacked(row[k], "<u4").astype(np.int64) for k in ("holders", "docs", "times"))
        c, best = counts.column("c").to_numpy()[order], counts.column("best").to_numpy(zero_copy_only=False)[order]
        total, most, links = (np.zeros(n, np.int64) for _ in range(3))
        np.add.at(total, docs_, np.repeat(c, holders) * times)
        np.add.at(most, docs_, np.repeat(best, holders) * times)
        np.add.at(links, docs_, times)
        columns = {"doc_id": row["doc_id"], **{k: row[k] for k in _SCALARS}, "n_links": links, "n_best": most, "count_sum": total, "groups_sha256": row["groups_sha256"]}
        return pa.table({k: pa.array(v, pa.string() if k == "groups_sha256" else pa.int64()) for k, v in columns.items()})

    return made.drop("pairs").groupBy("unit").cogroup(counted(unit_pairs(made, size)).groupBy("unit")).applyInArrow(sums, RESULT)
