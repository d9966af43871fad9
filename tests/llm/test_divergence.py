"""Distances of sources by their words, against brute force and SQL."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from forgelens.llm import divergence
from forgelens.llm.queries import ORACLE_SQL

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, least=3, ranks=200):
    rows = [tuple(x or "" for x in r) for r in rows]  # text, lang, source
    out = []
    for lang in {r[1] for r in rows}:
        mine = [(TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t)), s) for t, g, s in rows if g == lang]
        df = Counter(w for words, _ in mine for w in set(words))
        kept = sorted(w for w, c in df.items() if c >= least)
        n = defaultdict(Counter)
        for words, s in mine:
            n[s].update(w for w in words if df[w] >= least)
        all_ = sum(n.values(), Counter())
        p = {s: {w: 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + len(kept)) for w in kept} for s, c in n.items()}
        q = {w: 1 + 10**9 * (all_[w] + 1) // (sum(all_.values()) + len(kept)) for w in kept}
        f = lambda a, b: (a - b) ** 2 // b
        for s in p:
            pairs = sorted((-sum(f(p[s][w], p[t][w]) for w in kept), t.encode(), t) for t in p if t != s)
            terms = sorted((-f(p[s][w], q[w]), w.encode(), w) for w in kept if n[s][w] and p[s][w] > q[w])[:ranks]
            out += [(lang, s, part, item, -v, i + 1) for part, found in (("pair", pairs), ("term", terms)) for i, (v, _, item) in enumerate(found)]
    return sorted(out)


def result(found):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in found.collect())


@pytest.mark.parametrize(("held", "pairs"), [(600_000, 1 << 20), (40, 50)])
def test_divergence(spark, messy, monkeypatch, held, pairs):
    monkeypatch.setattr(divergence, "HELD", held)
    monkeypatch.setattr(divergence, "PAIRS", pairs)
    rng = random.Random(5)
    words = [f"{a}{b}" for a in ["w", "É", "中", "Z", "ab"] for b in "abcdefgh"]
    rows = []
    for i in range(400):
        lang = rng.choice(["en", "en", "de", None])
        source = "hot" if rng.random() < 0.4 else rng.choice(["a", "b", "é", "Z", None])
        own = words[: rng.choice([8, 20, 40])]
        rows.append((rng.choice([None, "", "12 34", *[" ".join(rng.choice(own) + rng.choice(["", "1", "_", "-"]) for _ in range(rng.randrange(30)))] * 9]), lang, source))
    rows += [("one two three", "rare", "x"), ("four", "rare", "y"), (None, "rare", "z")] + [("same words again", "en", "hot")] * 100
    d = spark.createDataFrame(rows, "text string, lang string, source string").repartition(5)
    assert result(divergence.divergence(d)) == brute(rows)
    assert [r for r in result(divergence.divergence(d)) if r[0] == "rare"] == [("rare", s, "pair", t, 0, i + 1) for s in "xyz" for i, t in enumerate(x for x in "xyz" if x != s)]
    assert result(divergence.divergence(messy)) == brute([(r["text"], r["lang"], r["source"]) for r in messy.collect()])
    assert divergence.divergence(messy.limit(0)).collect() == []


def test_shares_are_exact_beyond_64_bits():
    import numpy as np

    n, total = np.array([0, 9, 10**12, 7 * 10**12]), 10**13 + 7
    assert divergence.share(n, total).tolist() == [1 + 10**9 * (int(x) + 1) // total for x in n]


def test_divergence_is_the_sql(spark, tmp_path):
    path = "/root/testdata/sf0.001/documents.parquet"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    want = db.execute(f"SELECT lang, source, part, item, value, rank FROM ({ORACLE_SQL['op11_divergence']})").fetchall()
    assert result(divergence.divergence(spark.read.parquet(path))) == sorted(want)
