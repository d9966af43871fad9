"""Quality scores by positive-unlabelled learning.

A small network is fitted by the non-negative PU risk (Kiryo et al., "Positive-unlabeled learning
with non-negative risk estimator"): trusted positives against unlabelled texts, with a class prior
that is estimated from the same two samples (the least ratio of unlabelled to positive mass above a
score; Garg et al., "Mixture proportion estimation and PU learning"). Labels other than 1 are never
used. Inputs come from the whole text only: measures of its shape (character classes, repetition,
lengths), and hashed counts of its words, pairs of words and runs of four characters.

The two samples are drawn first, by a hash of id and place, so that rows without an id or with equal
ones are drawn like others, and hold at most about SAMPLE rows each; their inputs alone are made and
seen by the driver. Then one map makes the inputs of every document and scores them; they are never
written. Positives are found by their ids: of more than twice SAMPLE ids, that many are drawn, so what
is broadcast is bounded.

Defined results: a null or empty text has all inputs 0 and a score like any other; without any
positive the score is 0.5; labels may repeat; rows that repeat are scored alike; other columns of
the input are ignored, and none but the text enters a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forgelens.llm import sketches
from forgelens.llm.slices import by_bytes
from forgelens.llm.tables import cut

#: Rows in each of the two training samples, about; parts of the network and of its training.
SAMPLE, HIDDEN, STEPS, BATCH, DECAY = 20_000, 8, 400, 1024, 3e-3
PREDICT_FROM = 0.3
#: Measures of shape, buckets of hashed counts (half for words, half for characters), and how much less these weigh: there are many, and positives may be few.
MEASURES, GRAMS, GRAM_WEIGHT = 15, 128, 0.3
INPUTS = MEASURES + GRAMS

_BYTES = np.arange(256)
_CLASSES = [
    (_BYTES >= 65) & (_BYTES <= 90), (_BYTES >= 97) & (_BYTES <= 122), (_BYTES >= 48) & (_BYTES <= 57), np.isin(_BYTES, [32, 10]),
    np.isin(_BYTES, list(b".,;:")), np.isin(_BYTES, list(b"!?")), np.isin(_BYTES, list(b"|/\\<>{}[]=_~^")), np.isin(_BYTES, list(b"*#$%&@+")),
]
_CLASS = np.stack(_CLASSES, 1).astype(float)


def measures(text: str | None) -> np.ndarray:
    """Shares of character classes, and of distinct words, word triples and lines, with lengths."""
    out = np.zeros(MEASURES)
    if not text:
        return out
    b = text.encode()
    count = np.bincount(np.frombuffer(b, np.uint8), minlength=256)
    words, lines = b.split(), b.split(b"\n")
    n = len(words) or 1
    p = count[count > 0] / len(b)
    out[:8] = np.sqrt(count @ _CLASS / len(b))
    out[8] = np.log1p(len(b) / n)
    out[9] = len(set(words)) / n
    out[10] = len(set(zip(words, words[1:], words[2:]))) / max(1, n - 2)
    out[11] = len(set(lines)) / len(lines)
    out[12] = -(p * np.log2(p)).sum() / 8
    out[13] = np.log1p(n) / 10
    out[14] = np.log1p(n / len(lines)) / 10
    return out


def grams(texts: list[bytes]) -> np.ndarray:
    """A row of square roots of shares for each lower-cased text: words and their pairs, then runs of four bytes."""
    half, n = GRAMS // 2, len(texts)
    w, at = sketches.word_hashes(texts)
    row = np.repeat(np.arange(n), np.diff(at))
    pairs = np.flatnonzero(row[1:] == row[:-1])
    hashed = np.concatenate([w, sketches.mix(w[pairs] * np.uint64(3) + w[pairs + 1])])
    of = np.concatenate([row, row[pairs]])
    words = np.bincount(of * half + (hashed >> np.uint64(58)).astype(np.int64), minlength=n * half).reshape(n, half)
    b = np.frombuffer(b"   ".join([*texts, b""]), np.uint8).astype(np.uint32)
    runs = (b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]) * np.uint32(0x9E3779B1) if len(b) > 3 else np.zeros(0, np.uint32)
    inside = np.repeat(np.tile([True, False], n), [k for t in texts for k in (len(t), 3)])[: len(runs)]  # runs that begin in a text end in it or in the spaces behind it
    owner = np.repeat(np.arange(n), [len(t) for t in texts])[: inside.sum()]
    chars = np.bincount(owner * half + (runs[inside] >> np.uint32(26)).astype(np.int64), minlength=n * half).reshape(n, half)
    return np.concatenate([np.sqrt(x / np.maximum(1, x.sum(axis=1, keepdims=True))) for x in (words, chars)], axis=1)


def inputs_of(texts: list[str | None]) -> np.ndarray:
    """A row of INPUTS for each text."""
    found = [np.concatenate([np.stack([measures(t) for t in texts[first : first + len(run)]]), grams(run)], axis=1) for first, run in sketches.slices(texts)]
    return np.concatenate([np.zeros((0, INPUTS)), *found]).astype(np.float16)  # as they are kept, so that both uses give equal scores


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the inputs as 16-bit floats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, 1):
            rows = [x.tobytes() for x in inputs_of(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary())], names=["doc_id", "inputs"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, inputs binary")


def _rows(kept: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(kept), np.float16).reshape(-1, INPUTS).astype(float)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


class Network:
    """One hidden layer on standardised inputs and the squares of the measures."""

    def __init__(self, x: np.ndarray):
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        rng = np.random.default_rng(0)
        k = x.shape[1] + MEASURES
        self.w = [rng.normal(0, k**-0.5, (k, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]

    def inputs(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        shape = z[:, :MEASURES]
        return np.concatenate([shape, GRAM_WEIGHT * z[:, MEASURES:], shape * shape / 8], 1)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.w
        return np.tanh(self.inputs(x) @ a + b) @ c + d

    def slope(self, z: np.ndarray, to_output: np.ndarray) -> list[np.ndarray]:
        """Of the weights, given that of each row's output."""
        a, b, c, _ = self.w
        h = np.tanh(z @ a + b)
        back = to_output[:, None] * c * (1 - h * h)
        return [z.T @ back, back.sum(0), h.T @ to_output, to_output.sum(keepdims=True)]


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> Network:
    """Adam on the non-negative risk with the logistic loss."""
    net = Network(unlabelled)
    p, u, rng = net.inputs(positive), net.inputs(unlabelled), np.random.default_rng(1)
    m, v = [np.zeros_like(w) for w in net.w], [np.zeros_like(w) for w in net.w]
    for t in range(1, STEPS + 1):
        xp, xu = p[rng.integers(0, len(p), BATCH)], u[rng.integers(0, len(u), BATCH)]
        out_p, out_u = (np.tanh(z @ net.w[0] + net.w[1]) @ net.w[2] + net.w[3] for z in (xp, xu))
        negative = np.logaddexp(0, out_u).mean() - prior * np.logaddexp(0, out_p).mean()
        up, uu = prior * _sigmoid(out_p) / BATCH, _sigmoid(out_u) / BATCH
        if negative >= 0:
            parts = [(xp, -prior * _sigmoid(-out_p) / BATCH - up), (xu, uu)]
        else:  # the part that ought not to be negative is pushed back
            parts = [(xp, up), (xu, -uu)]
        slopes = [a + b for a, b in zip(*[net.slope(z, g) for z, g in parts])]
        rate = 0.02 * (1 - t / (STEPS + 1))
        for w, g, a, b in zip(net.w, slopes, m, v):
            g = g + DECAY * w
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            w -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
    return net


def estimated_prior(net: Network, positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The least ratio of unlabelled to positive mass above a score, with room for chance."""
    p, u = np.sort(net(positive)), np.sort(net(unlabelled))
    at = np.quantile(p, np.linspace(0, 0.9, 91))
    above_p, above_u = (1 - np.searchsorted(x, at) / len(x) for x in (p, u))
    chance = np.sqrt(np.log(20) / 2) * (len(p) ** -0.5 + len(u) ** -0.5)
    best = np.argmin((above_u + chance) / above_p)
    return float(np.clip(above_u[best] / above_p[best], 0.02, 0.98))


def fit_with_prior(positive: np.ndarray, unlabelled: np.ndarray) -> Network:
    """The prior comes from halves that the network for it hasn't seen."""
    prior = 0.5
    for _ in range(2):
        halves = [estimated_prior(fit(positive[i::2], unlabelled[i::2], prior), positive[1 - i :: 2], unlabelled[1 - i :: 2]) for i in (0, 1) if len(positive) > 1 < len(unlabelled)]
        prior = float(np.mean(halves)) if halves else prior
    return fit(positive, unlabelled, prior)


def _part_of(share: float, *of: str | Column) -> Column:
    """Whether a row is among about this share of all, by a hash."""
    return F.pmod(F.xxhash64(*of), F.lit(1 << 40)) < F.lit(int((1 << 40) * min(1.0, share)))


def _sample(rows: DataFrame, n: int, seed: int) -> np.ndarray:
    """The inputs of about SAMPLE of n rows (doc_id, text and at, a row's place), in a fixed order."""
    drawn = rows.filter(_part_of(SAMPLE / n, "doc_id", "at", F.lit(seed))) if n > SAMPLE else rows
    return _rows([m for _, m in sorted((r[0], bytes(r[1])) for r in measured(drawn).select(F.xxhash64("doc_id", F.lit(seed)), "inputs").collect())])


def _positives(ids: DataFrame, labels: DataFrame) -> tuple[DataFrame, int]:
    """Ids of trusted positives, about twice SAMPLE at most, and how many rows have them."""
    trusted = labels.filter(F.col("quality") == 1).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    found = cut(ids.groupBy("doc_id").agg(F.count("*").alias("c")).join(trusted, "doc_id"))
    n = found.count()
    if n > 2 * SAMPLE:
        found = found.filter(_part_of(2 * SAMPLE / n, "doc_id", F.lit(3)))
    return found.select("doc_id"), found.agg(F.sum("c")).first()[0] or 0


def held_out_part(doc_id: Column, parts: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(parts))


def trained(docs: DataFrame, labels: DataFrame) -> Network | None:
    """The network for documents, or None without positives."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("at"))
    seen = slim.filter(held_out_part(F.col("doc_id"), 5) != 0)
    ids, n = _positives(seen.select("doc_id"), labels)
    positive, unlabelled = _sample(seen.join(F.broadcast(ids), "doc_id", "left_semi"), n, 1), _sample(seen, seen.count(), 2)
    return fit_with_prior(positive, unlabelled) if len(positive) and len(unlabelled) else None


def scores(net: Network | None, x: np.ndarray) -> np.ndarray:
    return _sigmoid(net(x)) if net else np.full(len(x), 0.5)


def _scored(net: Network | None, b: pa.RecordBatch, text: int) -> np.ndarray:
    return scores(net, inputs_of(b.column(text).to_pylist()).astype(float))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document doc_id, held_out (its label wasn't used), score and predicted."""
    net = trained(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_scored(net, b, 1))], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held_out = held_out_part(F.col("doc_id"), 5) == 0
    return rows.mapInArrow(run, "doc_id long, score double").select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= PREDICT_FROM).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that aren't rejected, with all their columns (text has to be a string)."""
    net, at = trained(docs, labels), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, at):
            yield b.filter(pa.array(_scored(net, b, at) >= PREDICT_FROM))

    return docs.mapInArrow(run, docs.schema)
