"""Languages in two steps: the family first, then the language within it.

A linear support vector machine (squared hinge) for each family against the rest chooses the family;
within it, one machine for each pair of languages votes. Inputs are hashed byte n-grams (1 to 4) and
words of the lower-cased whole text, without digits and punctuation.

The machines are fitted on the driver on a sample that is drawn by hash, about SAMPLE rows over all
languages together; prediction is a map.

Defined results: a text that is null or has no letter is ``und`` with score 0; languages outside the
family table are families of their own; with one language learnt every text has it; with none, all
are ``und``; rows that repeat are predicted alike; other columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forgelens.llm.slices import by_bytes

#: Rows in the training sample, about; buckets of the hashed features; steps and decay of the fit.
SAMPLE, BUCKETS, STEPS, DECAY = 6000, 2048, 150, 1e-4

# Families by language code.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "bs", "sl", "mk"),
    "uralic": ("fi", "et", "hu"),
    "baltic": ("lt", "lv"),
    "celtic": ("ga", "gd", "cy", "br"),
    "turkic": ("tr", "az", "kk", "uz", "tt", "ky", "tk"),
    "indic": ("hi", "bn", "mr", "gu", "pa", "ne", "ur"),
    "semitic": ("ar", "he", "mt", "am"),
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}

_LETTER = re.compile(r"[^\W\d_]")
_NOT_LETTERS = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def family_of(lang: str) -> str:
    return _FAMILY.get(lang.split("-")[0].lower(), lang)


def features(text: str) -> np.ndarray:
    """Unit vector of the square roots of the counts of hashed n-grams and words."""
    words = text.lower().encode().translate(_NOT_LETTERS).split()
    a = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint32)
    count = np.zeros(BUCKETS)
    h = np.zeros(len(a), np.uint32)
    for n in range(1, 5):
        h = (h[: len(a) - n + 1] if n > 1 else h) * np.uint32(0x01000193) + a[n - 1 :] + np.uint32(n)
        count += np.bincount((h * np.uint32(0x9E3779B1)) >> np.uint32(21), minlength=BUCKETS)
    space = np.flatnonzero(a == 32)
    total = np.concatenate([[0], np.cumsum(a.astype(np.uint64) ** np.uint64(3) * np.uint64(0x9E3779B97F4A7C15))]).astype(np.uint64)
    word = (total[space[1:]] - total[space[:-1]]) ^ np.diff(space).astype(np.uint64)
    count += 2 * np.bincount(((word * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(53)).astype(np.int64), minlength=BUCKETS)
    out = np.sqrt(count)
    return (out / (np.linalg.norm(out) or 1)).astype(np.float32)


def machine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights (the last is the constant) for labels 1 and -1: squared hinge by accelerated gradient, classes weighted alike."""
    x = np.concatenate([x * 10, np.ones((len(x), 1), np.float32)], 1)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    y, weight = y.astype(np.float32), weight.astype(np.float32)
    w = ahead = np.zeros(x.shape[1], np.float32)
    rate = np.float32(1 / (2 * 101))
    for t in range(STEPS):
        slack = np.maximum(0, 1 - y * (x @ ahead))
        new = ahead - rate * (np.float32(DECAY) * ahead - 2 * ((weight * y * slack) @ x))
        w, ahead = new, new + np.float32(t / (t + 3)) * (new - w)
    w[:-1] *= 10
    return w.astype(float)


class Languages:
    """The fitted machines."""

    def __init__(self, x: np.ndarray, lang: np.ndarray):
        self.langs = sorted(set(lang))
        self.families = sorted({family_of(c) for c in self.langs})
        of = np.array([family_of(c) for c in lang])
        one_each = len(self.families) > 1
        self.family = np.stack([machine(x, np.where(of == f, 1.0, -1.0)) for f in self.families], 1) if one_each else None
        self.pairs = {}
        for f in self.families:
            for a, b in combinations([c for c in self.langs if family_of(c) == f], 2):
                rows = (lang == a) | (lang == b)
                self.pairs[a, b] = machine(x[rows], np.where(lang[rows] == a, 1.0, -1.0))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language, score) of each row; the score is the family's certainty times that of the language's weakest vote."""
        certain = lambda margin: 1 / (1 + np.exp(-np.clip(3 * margin, -50, 50)))
        x = np.concatenate([x, np.ones((len(x), 1), np.float32)], 1)
        if self.family is None:
            family, score = np.zeros(len(x), int), np.ones(len(x))
        else:
            margin = x @ self.family
            family = margin.argmax(1)
            score = certain(margin.max(1))
        out = np.empty(len(x), object)
        for i, f in enumerate(self.families):
            rows = np.flatnonzero(family == i)
            langs = [c for c in self.langs if family_of(c) == f]
            votes, weakest = np.zeros((len(rows), len(langs))), np.ones((len(rows), len(langs)))
            for a, b in combinations(range(len(langs)), 2):
                p = certain(x[rows] @ self.pairs[langs[a], langs[b]])
                for k, q in ((a, p), (b, 1 - p)):
                    votes[:, k] += (q > 0.5) + q / (len(langs) + 1)
                    weakest[:, k] = np.minimum(weakest[:, k], q)
            best = votes.argmax(1)
            out[rows] = np.array(langs, object)[best]
            score[rows] *= weakest[np.arange(len(rows)), best]
        return out, score


def _slim(docs: DataFrame, *more: str | Column) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def _fit(docs: DataFrame) -> Languages | None:
    """From rows with text and lang."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, 1):
            x = [features(t).astype("<f2").tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(x, pa.binary())], names=["doc_id", "lang", "x"])

    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r[0]: r[1] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return None
    each = SAMPLE / len(counts)
    share = F.create_map(*[F.lit(x) for c, n in counts.items() for x in (c, min(1.0, each / n))])[F.col("lang")]
    chance = F.pmod(F.xxhash64("doc_id", "at"), F.lit(1 << 40)) / F.lit(float(1 << 40))  # rows without an id or with equal ones are drawn like others
    drawn = _slim(known, "lang", F.monotonically_increasing_id().alias("at")).filter(chance < share).select("doc_id", "text", "lang").mapInArrow(run, "doc_id long, lang string, x binary").toPandas().sort_values(["lang", "doc_id"])
    x = np.frombuffer(b"".join(drawn["x"]), "<f2").reshape(-1, BUCKETS).astype(np.float32)
    return Languages(x, drawn["lang"].to_numpy(str)) if len(x) else None


def predict_languages(docs: DataFrame) -> DataFrame:
    """Per document doc_id, held_out (not learnt from), lang_pred and score."""
    part = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(4))
    fitted = _fit(docs.filter(part != 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, 1):
            lang, score = np.full(b.num_rows, "und", object), np.zeros(b.num_rows)
            rows, x = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                if fitted and t and _LETTER.search(t):
                    rows.append(i)
                    x.append(features(t))
            if rows:
                lang[rows], score[rows] = fitted.predict(np.stack(x))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    found = _slim(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", (part == 2).alias("held_out"), "lang_pred", "score")
