"""Near-duplicate documents: fast similarity sketches, banding, exact verification, components.

1. One pass over the texts makes each document's shingle set, its digest and its band keys.
   Documents with equal sets are one class from here on, with a number of its own.
2. Classes that share a band key are in a bucket. A class is closed, exactly, if so many of its
   shingles occur in no other candidate that no other set can reach the similarity. In each bucket
   the open member with the smallest share of such shingles is the hub; the others are checked
   against it on full sets, which connects most of a group with as many checks as it has members.
3. A bucket whose members are then in several components has outsiders: members of other components
   than its largest. They are checked on full sets against all its members of other components, in
   tiles of a bounded number of sets each, so neither a pair of the largest component nor a row for
   a pair that isn't linked is ever made, and no pair that could connect two components is left out.
4. Classes that share a doc_id are linked too. Components over all links; each document's is that of
   its class, named by the least doc_id in it.

The bands miss a pair at exactly the least similarity with probability (1 - 0.85 ** 6) ** 28, about
2e-6; larger similarities are missed less. All else is exact on 64-bit shingle hashes.

Defined results: a text without words (null, empty, blank) has no shingles and is linked with
nothing; one with fewer words than a shingle is one shingle; rows that repeat are copies; if a
doc_id repeats with different texts, links of each row count for the id; a row without a doc_id stands
for itself: it links what is near its text, has the least doc_id that it reaches as its component_id
(null if it reaches none) and is kept if there is none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forgelens.llm import sketches
from forgelens.llm.components import components
from forgelens.llm.slices import by_bytes
from forgelens.llm.tables import cut

#: Sets on either side of a tile.
TILE = 64


def _texts(docs: DataFrame) -> DataFrame:
    text = docs["text"].cast("string")
    given = docs["doc_id"].cast("long")
    return docs.select(F.coalesce(given, F.lit(0).cast("long")).alias("id"), text.alias("text"), F.xxhash64(text).alias("h"), given.isNull().alias("no_id"))


def _batches(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[list[pa.Array], list[np.ndarray]]]:
    """Columns other than the text, and shingle sets."""
    for b in by_bytes(batches, 1):
        for first, run in sketches.slices(b.column(1).to_pylist()):
            yield [b.column(i).slice(first, len(run)) for i in (0, 2, 3)], sketches.shingle_sets(run, k)


def _lists(rows: list[np.ndarray] | np.ndarray) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)])
    flat = np.concatenate([np.zeros(0, np.uint64), *rows]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))


def sketched(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """id (0 beside no_id), the text's hash h, no_id, the set's size n, its digest and its band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for others, sets in _batches(batches, k):
            d, n = sketches.digests(sets).view(np.int64), np.array([len(s) for s in sets], np.int64)
            keys = _lists(sketches.band_keys(sketches.sketches(sets, bands * rows), rows))
            yield pa.RecordBatch.from_arrays([*others, pa.array(n), pa.array(d[:, 0]), pa.array(d[:, 1]), keys], names=["id", "h", "no_id", "n", "d1", "d2", "keys"])

    return _texts(docs).mapInArrow(run, "id long, h long, no_id boolean, n long, d1 long, d2 long, keys array<long>")


def shingled(texts: DataFrame, k: int) -> DataFrame:
    """The sorted shingle set, its size n and its digest, once for each set; texts as _texts gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _batches(batches, k):
            n, d = np.array([len(s) for s in sets], np.int64), sketches.digests(sets).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(d[:, 0]), pa.array(d[:, 1]), _lists(sets)], names=["n", "d1", "d2", "shingles"])

    return texts.select("id", "text", "h", "no_id").mapInArrow(run, "n long, d1 long, d2 long, shingles array<long>").dropDuplicates(["n", "d1", "d2"])


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    for side in "ab":
        pairs = pairs.join(sets.select(F.col("rep").alias(side), F.col("n").alias(f"n_{side}"), F.col("shingles").alias(f"s_{side}")), side)
    both = F.size(F.array_intersect("s_a", "s_b"))
    return pairs.filter(100 * both >= percent * (F.col("n_a") + F.col("n_b") - both)).select("a", "b").distinct()


def _open_members(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Members that their own shingles don't rule out, with the share of these."""
    unique = sets.select("rep", F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("c"), F.min("rep").alias("rep")).filter("c = 1")
    own = cut(unique.groupBy("rep").agg(F.count("*").alias("own")))
    odd = members.join(own, "rep", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    return odd.filter(100 * (F.col("n") - F.col("own")) >= percent * F.col("n")).select("key", "rep", "n", (F.col("own") / F.col("n")).alias("odd"))


def _hub_pairs(members: DataFrame, percent: int) -> DataFrame:
    hubs = cut(members.groupBy("key").agg(F.count("*").alias("c"), F.min(F.struct("odd", "rep", "n")).alias("hub")).filter("c > 1"))
    near = members.join(hubs.select("key", "hub"), "key").filter("rep <> hub.rep").filter(100 * F.least("n", "hub.n") >= percent * F.greatest("n", "hub.n"))
    return near.select(F.least("rep", "hub.rep").alias("a"), F.greatest("rep", "hub.rep").alias("b")).distinct()


def _tile_links(members: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between outsiders of buckets and their members of other components."""
    labelled = members.join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left")
    labelled = cut(labelled.select("key", "rep", F.coalesce("label", "rep").alias("label")))
    counts = labelled.groupBy("key", "label").agg(F.count("*").alias("c"))
    of = counts.groupBy("key").agg(F.max(F.struct("c", "label")).alias("most"), F.sum("c").alias("c"))
    tiles = lambda c: F.ceil(c / F.lit(TILE)).cast("int")
    mixed = cut(of.filter("c > most.c").select("key", F.col("most.label").alias("most"), tiles(F.col("c")).alias("across"), tiles(F.col("c") - F.col("most.c")).alias("down")))
    rows = labelled.join(mixed, "key")
    own = F.pmod(F.xxhash64("rep"), F.col("across")).cast("int")
    all_ = rows.select("key", "rep", "label", F.lit(False).alias("outsider"), own.alias("x"), F.explode(F.sequence(F.lit(0), F.col("down") - 1)).alias("y"))
    own = F.pmod(F.xxhash64("rep"), F.col("down")).cast("int")
    outside = rows.filter("label <> most").select("key", "rep", "label", F.lit(True).alias("outsider"), F.explode(F.sequence(F.lit(0), F.col("across") - 1)).alias("x"), own.alias("y"))

    def check(unit: pa.Table) -> pa.Table:
        unit = unit.combine_chunks()
        rep, label, n = (unit.column(c).to_numpy() for c in ("rep", "label", "n"))
        out = unit.column("outsider").to_numpy()
        shingles = [x.values.to_numpy().view(np.uint64) for x in unit.column("shingles")]
        inside = np.flatnonzero(~out)
        flat = np.concatenate([np.zeros(0, np.uint64), *[shingles[i] for i in inside]])
        order = np.argsort(flat)
        flat, owner = flat[order], np.repeat(np.arange(len(inside)), [len(shingles[i]) for i in inside])[order]
        pairs = []
        for i in np.flatnonzero(out):
            lo, hi = np.searchsorted(flat, shingles[i], "left"), np.searchsorted(flat, shingles[i], "right")
            found = hi - lo
            at = np.repeat(lo - np.cumsum(found) + found, found) + np.arange(found.sum())
            both = np.bincount(owner[at], minlength=len(inside))
            linked = (100 * both >= percent * (n[i] + n[inside] - both)) & (label[inside] != label[i])
            pairs += [(int(rep[i]), int(rep[j])) for j in inside[linked]]
        a, b = zip(*pairs) if pairs else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    units = all_.unionByName(outside).join(sets.select("rep", "n", "shingles"), "rep")
    return units.groupBy("key", "x", "y").applyInArrow(check, "a long, b long").distinct()


def links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) that connect all linked members (key, rep, n) of the buckets."""
    members = cut(_open_members(members, sets, percent))
    edges = cut(_linked(_hub_pairs(members, percent), sets, percent))
    return edges.unionByName(cut(_tile_links(members, cut(components(edges)), sets, percent)))


def _named(docs: DataFrame, k: int, percent: int, bands: int, rows: int) -> DataFrame:
    """Per row no_id, id, the text's hash h, the set's size n and component_id (null if no doc_id is in it)."""
    info = cut(sketched(docs, k, bands, rows))
    classes = info.filter("n > 0").groupBy("n", "d1", "d2").agg(F.min(F.struct("no_id", "id", "h")).alias("least"), F.first("keys").alias("keys"))
    classes = cut(classes.select("n", "d1", "d2", "least.no_id", "least.id", "least.h", "keys").withColumn("rep", F.monotonically_increasing_id()))
    keys = classes.select("rep", "n", F.explode("keys").alias("key"))
    shared = cut(keys.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key"))
    members = cut(keys.join(shared, "key").select("key", "rep", "n"))
    candidates = cut(classes.join(members.select("rep").distinct(), "rep", "left_semi").select("rep", "no_id", "id", "h", "n", "d1", "d2"))
    texts = _texts(docs).join(candidates.select("no_id", "id", "h").distinct().hint("shuffle_hash"), ["no_id", "id", "h"], "left_semi")  # one text of each candidate; they grow with the documents
    sets = cut(shingled(texts, k).join(candidates, ["n", "d1", "d2"]).select("rep", "n", "shingles"))
    own = classes.select("n", "d1", "d2", "rep", F.when(~F.col("no_id"), F.col("id")).alias("least"))
    placed = cut(info.drop("keys").join(own, ["n", "d1", "d2"], "left").select("no_id", "id", "h", "n", "rep", "least"))
    with_id = placed.filter(~F.col("no_id"))
    several = cut(with_id.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).filter("a < b").select("id", "a"))
    same_id = with_id.join(several, "id").select("a", F.col("rep").alias("b")).filter("a <> b").distinct()
    labels = cut(components(links(members, sets, percent).unionByName(same_id)).select(F.col("node").alias("rep"), "label"))
    named = cut(labels.join(own.filter("least is not null").select("rep", "least"), "rep").groupBy("label").agg(F.min("least").alias("name")))
    whole = placed.join(labels.join(named, "label").select("rep", "name"), "rep", "left")
    return whole.withColumn("component_id", F.coalesce("name", "least", F.when(~F.col("no_id"), F.col("id")))).select("no_id", "id", "h", "n", "component_id")


def _kept() -> Column:
    return F.when(F.col("no_id"), F.col("component_id").isNull()).otherwise(F.col("id") == F.col("component_id"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 85, bands: int = 28, rows: int = 6) -> DataFrame:
    """Per row doc_id, n_shingles, component_id (the least doc_id reachable over links) and kept (it is its component's least)."""
    found = _named(docs, k, percent, bands, rows)
    return found.select(F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", _kept().alias("kept"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 85, bands: int = 28, rows: int = 6) -> DataFrame:
    """The documents, with their columns, of which each is the least of its component.

    Of rows with equal doc_id and text one stays. A row without a doc_id goes if any row with one is in
    its component; where none is, all of them stay.
    """
    found = cut(_named(docs, k, percent, bands, rows).withColumn("kept", _kept()))
    gone = found.filter("not kept and not no_id").select("id").distinct()
    left = docs.join(gone, docs["doc_id"] == gone["id"], "left_anti")
    nameless = found.filter("not kept and no_id").select("h").distinct()
    if not nameless.isEmpty():
        left = left.join(nameless, docs["doc_id"].isNull() & (F.xxhash64(docs["text"].cast("string")) == nameless["h"]), "left_anti")
    repeated = cut(found.filter("kept and not no_id").groupBy("id").agg(F.count("*").alias("c")).filter("c > 1").select("id"))
    if repeated.isEmpty():
        return left
    once = left.join(repeated, docs["doc_id"] == repeated["id"], "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(repeated, docs["doc_id"] == repeated["id"], "left_anti").unionByName(once)
