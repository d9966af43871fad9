"""Shingle sets of texts and fast similarity sketches of sets, in numpy, many documents at a time.

Hashes are 64 bits. A word's hash is a polynomial over its bytes, taken from prefix sums; a
shingle's is a mixed sum over its words.

The sketch (Dahlgaard, Knudsen and Thorup, "Fast similarity sketching") has t coordinates. In round
i < t every element goes to one hashed bin with a hashed value; in round t + j every element goes to
bin j, so after 2 t rounds each bin is filled. Values of earlier rounds are smaller. A document drops
out as soon as its bins are full, mostly after the first round.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Bytes of text handled together (one longer text is handled alone).
SLICE_BYTES = 1 << 20
U = np.uint64
_FULL = np.iinfo(np.uint64).max
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2 ** 64


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_LETTER = mix(np.arange(1, 257, dtype=np.uint64) * U(_BASE))
_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])


@lru_cache(maxsize=2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, up to 2 ** bits of them."""
    steps = [np.full(1 << bits, b, np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    for s in steps:
        s[0] = 1
    return np.cumprod(steps[0]), np.cumprod(steps[1])


def slices(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """(first, lower-cased texts as bytes) of runs of texts of a bounded size. Only A-Z are lowered."""
    first, run, size = 0, [], 0
    for i, t in enumerate(texts):
        b = t.encode().lower() if t else b""
        if run and size + len(b) > SLICE_BYTES:
            yield first, run
            first, run, size = i, [], 0
        run.append(b)
        size += len(b)
    if run:
        yield first, run


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and for each text where its words begin (with the end of the last)."""
    a = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    space = _SPACE[a]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    power, inverse = _powers(max(20, int(len(a)).bit_length()))
    total = np.empty(len(a) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_LETTER[a] * power[: len(a)], out=total[1:])
    begins = np.cumsum([1, *[len(t) + 1 for t in texts]])
    return mix((total[end] - total[start]) * inverse[start]), np.searchsorted(start, begins)


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of each text; fewer words are one shingle."""
    w, at = word_hashes(texts)
    factor = mix(np.arange(1, k + 1, dtype=np.uint64)) | U(1)
    n = max(0, len(w) - k + 1)
    s = np.zeros(n, np.uint64)
    for j in range(k):
        s += w[j : n + j] * factor[j]
    s = mix(s + U(k))
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(s[a : b - k + 1]))
        elif b > a:
            out.append(mix((w[a:b] * factor[: b - a]).sum(dtype=np.uint64)[None] + U(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def digests(sets: list[np.ndarray]) -> np.ndarray:
    """128 bits that depend on the whole set."""
    out = np.zeros((len(sets), 2), np.uint64)
    for i, s in enumerate(sets):
        out[i] = mix(s + U(1)).sum(dtype=np.uint64), mix(s ^ U(_BASE)).sum(dtype=np.uint64)
    return out


def sketches(sets: list[np.ndarray], t: int) -> np.ndarray:
    """A row of t values for each set; an empty set's are all the largest value."""
    out = np.full((len(sets), t), _FULL, np.uint64)
    flat = out.ravel()
    docs = np.flatnonzero([len(s) for s in sets])
    x = np.concatenate([sets[i] for i in docs]) if len(docs) else np.zeros(0, np.uint64)
    row = np.repeat(docs, [len(sets[i]) for i in docs]) if len(docs) else docs
    for i in range(2 * t):
        if not len(x):
            break
        z = mix(x ^ mix(np.array([i + 1], np.uint64) * U(_BASE)))
        bins = ((z >> U(32)) * U(t) >> U(32)).astype(np.int64) if i < t else i - t
        np.minimum.at(flat, row * t + bins, (U(i) << U(54)) | (mix(z) >> U(10)))  # 10 bits of the round: t up to 512
        if i < 8 or i % 8 == 7:  # to look costs as much as a round
            open_rows = (out == _FULL).any(axis=1)
            keep = open_rows[row]
            x, row = x[keep], row[keep]
    return out


def band_keys(sketch: np.ndarray, rows: int) -> np.ndarray:
    """One hash for each run of so many coordinates."""
    n, t = sketch.shape
    parts = sketch.reshape(n, t // rows, rows)
    key = mix(np.arange(1, t // rows + 1, dtype=np.uint64))[None, :]
    for j in range(rows):
        key = mix(key ^ parts[:, :, j])
    return key
