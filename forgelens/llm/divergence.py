"""How far the words of sources differ, by language: a sort-based stream over (lang, term, source).

1. Each task counts the terms of its documents by language and source: occurrences, and documents that
   hold the term (a document is in one task only, so both may be summed). What is shuffled has one row
   for each term and source of a few thousand documents, not for each document.
2. Rows are dealt by (lang, term), sorted by source within, and scanned once: a run of equal terms
   gives the document frequency of its language and the counts of its sources. Terms of enough
   documents are kept, a row each.
3. A second scan gives each run's partial values: terms of the sources that use them more than their
   language does, and sums for pairs of sources that both have the term. What a pair gets from terms
   that one of them lacks, or both, follows from how many terms a source has how often, so no row or
   sum is ever made for a term and a source without it.

The shares of sources and their language are integers, and so is everything made of them: results
don't depend on the order of anything.

What the driver and every task see whole is a row for each (lang, source) with its totals. The result
has a row for each pair of sources of a language, so these rows are about the square root of it.

Defined results: null text, lang and source count as ''; a group without terms is compared like others
(its shares are those of terms that don't occur); a language without kept terms gives pairs of value
0 and no terms; rows that repeat or share an id are documents of their own; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from forgelens.llm.slices import by_bytes
from forgelens.llm.tables import cut

#: Documents that a kept term is in; the unit of shares; ranks of terms.
LEAST_DOCUMENTS, UNIT, RANKS = 3, 1_000_000_000, 200
#: Counted terms that a task holds before it passes them on; pairs of a slice of the second scan.
HELD, PAIRS = 600_000, 1 << 20

COUNTS = "lang string, term string, source string, holders long, n long"
KEPT = "lang string, term string, sources array<string>, counts array<long>"
PARTIAL = "lang string, source string, part string, item string, value long"
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: str) -> list[bytes]:
    """Runs of letters A-Z, which are lowered, a-z and characters beyond ASCII."""
    return text.encode().translate(_TERMS).split()


def counted(docs: DataFrame) -> DataFrame:
    """Per task and (lang, term, source) how many documents hold the term and how often; the term '' stands for the group itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def held() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, holders) in counts.items():
                found = [b"", *n]
                columns = [[lang] * len(found), found, [source] * len(found), [0, *map(holders.__getitem__, n)], [0, *n.values()]]
                arrays = [pa.array(columns[0]), pa.array(columns[1], pa.binary()).cast(pa.string()), pa.array(columns[2]), *[pa.array(c, pa.int64()) for c in columns[3:]]]
                yield pa.RecordBatch.from_arrays(arrays, names=["lang", "term", "source", "holders", "n"])
            counts.clear()

        for b in by_bytes(batches, 2):
            for lang, source, text in zip(*(c.to_pylist() for c in b.columns)):
                n, holders = counts.setdefault((lang, source), (Counter(), Counter()))
                found = terms(text)
                n.update(found)
                holders.update(set(found))
            if sum(len(n) for n, _ in counts.values()) > HELD:
                yield from held()
        yield from held()

    given = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    return docs.select(*given).mapInArrow(run, COUNTS)


def _changes(column: pa.Array) -> np.ndarray:
    """Where a value differs from the one before."""
    return pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)


def kept_terms(rows: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """A row for each run of (lang, term) that enough documents hold, with its sources and counts; the group rows, as the term '', whole."""
    names = ["lang", "term", "source", "holders", "n"]

    def scanned(b: pa.RecordBatch | pa.Table, last: bool) -> tuple[pa.RecordBatch, pa.RecordBatch]:
        """(runs that have ended, rows of the one that hasn't, one for each of its sources)"""
        lang, term, source, holders, n = (pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c for c in b.columns)
        new = _changes(lang) | _changes(term)
        run = np.flatnonzero(np.concatenate([[True], new]))
        entry = np.flatnonzero(np.concatenate([[True], new | _changes(source)]))
        sums = [np.add.reduceat(c.to_numpy(), entry) for c in (holders, n)]
        first = np.searchsorted(entry, run)  # each run's first entry
        done = len(run) if last else len(run) - 1
        end = len(entry) if last else first[-1]
        left = [c.take(pa.array(entry[end:])) for c in (lang, term, source)] + [pa.array(x[end:]) for x in sums]
        at = pa.array(run[:done])
        offsets = pa.array(np.concatenate([first[:done], [end]]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, x) for x in (source.take(pa.array(entry[:end])), pa.array(sums[1][:end]))]
        found = pa.RecordBatch.from_arrays([lang.take(at), term.take(at), *lists], names=["lang", "term", "sources", "counts"])
        enough = np.add.reduceat(sums[0], first)[:done] >= least
        group = pc.equal(found.column(1), "").to_numpy(zero_copy_only=False)
        return found.filter(pa.array(enough | group)), pa.RecordBatch.from_arrays(left, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for b in batches:
            if b.num_rows:
                found, left = scanned(pa.Table.from_batches([left, b]) if left is not None else b, False)
                yield found
        if left is not None:
            yield scanned(left, True)[0]

    return rows.repartition("lang", "term").sortWithinPartitions("lang", "term", "source").mapInArrow(run, KEPT)


def share(n: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(UNIT * (n + 1) / total), exactly."""
    n, total = np.asarray(n, np.int64), np.asarray(total, np.int64)
    if n.size and int(n.max()) >= (1 << 63) // UNIT - 1:
        return np.array([1 + UNIT * (x + 1) // y for x, y in zip(n.tolist(), np.broadcast_to(total, n.shape).tolist())], np.int64)
    return 1 + UNIT * (n + 1) // total


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q) ** 2 / q); both are UNIT + 1 at most, so the square fits."""
    return (p - q) * (p - q) // q


class Groups:
    """Totals of the groups of each language: its sources in order, their counts of kept terms and these terms' number."""

    def __init__(self, rows: list[tuple[str, str, int, int]]):
        """rows: lang, source, the sum of its counts, and the language's number of kept terms."""
        self.of: dict[str, tuple[list[str], dict[str, int], np.ndarray, int, int]] = {}
        by: dict[str, list[tuple[str, int, int]]] = {}
        for lang, source, n, kept in rows:
            by.setdefault(lang, []).append((source, n, kept))
        for lang, found in by.items():
            found.sort()
            names, n, kept = [x[0] for x in found], np.array([x[1] for x in found], np.int64), found[0][2]
            self.of[lang] = names, {s: i for i, s in enumerate(names)}, n + kept, int(n.sum()) + kept, kept


def partial_values(kept: DataFrame, groups: Groups) -> DataFrame:
    """Of each run: the terms that sources use more than their language, and for pairs of sources with the term what the sums by count don't tell."""

    def pairs(p: np.ndarray, none: np.ndarray, of: np.ndarray, at: np.ndarray, size: int, sums: dict[int, int]) -> None:
        """p: shares of the entries (run by run, from at[i] to at[i + 1]), none: of the same source for a term that it lacks, of: its place."""
        k = np.diff(at)
        begins = np.repeat(at[:-1], k)  # of each entry's run
        width = np.repeat(k, k)
        ends = np.cumsum(width)
        first = 0
        while first < len(p):
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + PAIRS, "right")))
            w = width[first:last]
            x = np.repeat(np.arange(first, last), w)
            y = np.repeat(begins[first:last], w) + np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
            x, y = x[x != y], y[x != y]
            value = distance(p[x], p[y]) - distance(p[x], none[y]) - distance(none[x], p[y]) + distance(none[x], none[y])
            code, where = np.unique(of[x] * size + of[y], return_inverse=True)
            total = np.zeros(len(code), np.int64)
            np.add.at(total, where, value)
            for c, v in zip(code.tolist(), total.tolist()):
                sums[c] = sums.get(c, 0) + v
            first = last

    def rows(lang: list[str], source: list[str], part: str, item: list[str], value: list[int]) -> pa.RecordBatch:
        arrays = [*[pa.array(c, pa.string()) for c in (lang, source, [part] * len(item), item)], pa.array(value, pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, names=["lang", "source", "part", "item", "value"])

    def summed(lang: str, found: dict[int, int]) -> pa.RecordBatch:
        names, codes, values = groups.of[lang][0], list(found), list(found.values())
        found.clear()
        return rows([lang] * len(codes), [names[c // len(names)] for c in codes], "pair", [names[c % len(names)] for c in codes], values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, dict[int, int]] = {}
        for b in batches:
            langs = np.array(b.column(0).to_pylist(), object)
            for lang in set(langs):
                names, place, total, all_, _ = groups.of[lang]
                mine = b.filter(pa.array(langs == lang))
                term = mine.column(1).to_pylist()
                of = np.array([place[s] for s in pc.list_flatten(mine.column(2)).to_pylist()], np.int64)
                n = pc.list_flatten(mine.column(3)).to_numpy(zero_copy_only=False)
                k = pc.list_value_length(mine.column(3)).to_numpy(zero_copy_only=False)
                at = np.concatenate([[0], np.cumsum(k)])
                p, q = share(n, total[of]), np.repeat(share(np.add.reduceat(n, at[:-1]), all_), k)
                more = np.flatnonzero((n > 0) & (p > q))
                item = np.repeat(np.arange(len(term)), k)[more]
                yield rows([lang] * len(more), [names[i] for i in of[more]], "term", [term[i] for i in item], distance(p[more], q[more]).tolist())
                found = sums.setdefault(lang, {})
                pairs(p, share(np.zeros(len(of), np.int64), total[of]), of, at, len(names), found)
                if len(found) > HELD:
                    yield summed(lang, found)
        for lang, found in sums.items():
            yield summed(lang, found)

    return kept.mapInArrow(run, PARTIAL)


def _share(n: Column, total: Column) -> Column:
    return F.call_function("div", F.lit(UNIT).cast("decimal(20,0)") * (n + 1), total) + 1


def _distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def by_counts(kept: DataFrame, totals: DataFrame) -> DataFrame:
    """For every pair of sources what follows from how many terms each has how often, as if no term were in both."""
    have = cut(kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).filter("x.counts > 0").groupBy("lang", F.col("x.sources").alias("source"), F.col("x.counts").alias("n")).agg(F.count("*").alias("m")))
    none = F.lit(0).cast("long")
    other = totals.select("lang", F.col("source").alias("item"), F.col("total").alias("of_item"))
    sums = have.join(totals.select("lang", "source", "total"), ["lang", "source"]).join(other, "lang").filter("source <> item")
    p = _share(F.col("n"), F.col("total"))
    own, q = _share(none, F.col("total")), _share(none, F.col("of_item"))
    exact = lambda c: c.cast("decimal(38,0)")
    lacking = exact(_distance(own, q)) * F.col("m")  # these terms aren't among those that both lack
    there = sums.select("lang", "source", "item", (exact(_distance(p, q)) * F.col("m") - lacking).alias("value"))
    back = sums.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), (exact(_distance(q, p)) * F.col("m") - exact(_distance(q, own)) * F.col("m")).alias("value"))
    empty = totals.join(other, "lang").filter("source <> item")
    empty = empty.select("lang", "source", "item", F.when(F.col("kept") > 0, exact(_distance(own, q)) * F.col("kept")).otherwise(0).cast("decimal(38,0)").alias("value"))
    return there.unionByName(back).unionByName(empty)


def divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, ranks: int = RANKS) -> DataFrame:
    """Per (lang, source): every other source of the language by the distance of their shares (part pair), and the terms that it uses more than the language by theirs (part term), ranked."""
    kept = cut(kept_terms(counted(docs), least))
    all_ = kept.select("lang", (F.col("term") != "").cast("long").alias("is_term"), F.explode(F.arrays_zip("sources", "counts")).alias("x"))
    sizes = kept.groupBy("lang").agg(F.sum((F.col("term") != "").cast("long")).alias("kept"))
    totals = all_.groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("n"))
    totals = cut(totals.join(sizes, "lang").withColumn("total", F.greatest(F.col("n") + F.col("kept"), F.lit(1))))
    groups = Groups([tuple(r) for r in totals.select("lang", "source", "n", "kept").collect()])  # a row for each source of a language
    terms_ = kept.filter("term <> ''")
    found = cut(partial_values(terms_, groups))
    exact = F.col("value").cast("decimal(38,0)")
    pairs = found.filter("part = 'pair'").select("lang", "source", "item", exact.alias("value")).unionByName(by_counts(terms_, totals))
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value")).withColumn("part", F.lit("pair"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    top = found.filter("part = 'term'").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= ranks)
    whole = pairs.withColumn("rank", F.row_number().over(order)).unionByName(top)
    return whole.select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))
