"""Shards of nearly equal sizes by sampled splitters.

Records have a total order: the hash of the group that they belong to (equal texts, say), then their
id, then a hash of their place in the input. Each record is drawn with a chance in proportion to its
size; quantiles of the draws split the order into ranges, and a range that holds more than twice its
share is split again by draws from inside it. Sizes and counts of the ranges, summed before each, place
every record at a position of the whole order.

Large groups (more than a LARGE-th part of a shard's share of bytes or rows, so there are a few hundred)
are given to shards first, the largest to the emptiest, whole where one has the room and else in as few
parts as there are shards to take them. What room is left is filled with all others in their order: a
group goes where its first record does, so it stays whole. Shards differ from their share by less than
the largest record or a LARGE-th part, whichever is more.

Ranges begin with whole groups but for large ones, which are split over as many ranges as their sizes ask
for, by id and then by place: no group and no id meets in one task.

DataFrame functions only. There are more ranges the more records there are, so a range's task doesn't
grow with the table; the driver sees the large groups, a few draws and one row for each range, about a
kilobyte for each million records.

Defined results: an empty table gives no rows; null ids come first in the order; rows that are equal
in group and id are interchangeable; all columns of the input are kept, and the results
replace columns of the same names.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from forgelens.llm.tables import cut

#: Ranges for each shard at least, records of a range at most in the mean, draws for each range, how often overfull ranges are split again, and which part of a shard's share makes a group large.
RANGES, ROWS, DRAWS, SPLITS, LARGE = 16, 2_000_000, 16, 4, 16
_LEAST = -(1 << 63)

#: Group, id and place.
Key = tuple[int, int, int]
_KEY = ("_group", "_key", "_place")


def _range_of(splitters: list[Key]) -> Column:
    """The number of splitters at or below the record's key, by binary search in constant arrays."""
    if not splitters:
        return F.lit(0)
    sides = [F.split(F.lit(",".join(map(str, side))), ",").cast("array<long>") for side in zip(*splitters)]  # Catalyst folds each into one constant
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(splitters).bit_length()))])

    def at_or_below(i: Column) -> Column:  # no such splitter: null, which counts as false
        out = F.get(sides[-1], i) <= F.col(_KEY[-1])
        for name, side in zip(_KEY[-2::-1], sides[-2::-1]):
            out = (F.get(side, i) < F.col(name)) | ((F.get(side, i) == F.col(name)) & out)
        return out

    return F.aggregate(steps, F.lit(0), lambda found, step: F.when(at_or_below(found + step - 1), found + step).otherwise(found))


def _draws(records: DataFrame, share: Column, seed: int, large: set[int]) -> list[Key]:
    """Keys of records that are drawn, of groups that aren't large the first key; share: each record's chance."""
    chance = F.pmod(F.xxhash64(*_KEY, F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return sorted(tuple(r) if r[0] in large else (r[0], _LEAST, _LEAST) for r in records.filter(chance < share).select(*_KEY).collect())


def _quantiles(draws: list[Key], ranges: int) -> set[Key]:
    return {draws[len(draws) * i // ranges] for i in range(1, ranges)} if draws else set()


def _splitters(records: DataFrame, total: float, ranges: int, large: set[int]) -> list[Key]:
    """total: the sum of all weights."""
    size = F.col("_weight")
    found = sorted(_quantiles(_draws(records, size * F.lit(ranges * DRAWS / total), 0, large), ranges))
    for again in range(1, SPLITS + 1):
        placed = records.withColumn("_range", _range_of(found))
        sizes = {r[0]: (r[1], r[2]) for r in placed.groupBy("_range").agg(F.sum("_weight"), F.count("*")).collect()}
        over = {k: s for k, (s, n) in sizes.items() if n > 1 and s > 2 * total / ranges}
        if not over:
            break
        share = F.lit(0.0)
        for k, s in over.items():
            share = F.when(F.col("_range") == k, F.lit(DRAWS * -(-s * ranges // total) / s)).otherwise(share)
        draws = _draws(placed, share * size, again, large)
        at = {k: [d for d in draws if bisect_left(found, d) + (d in found) == k] for k in over}
        more = set().union(*(_quantiles(d, int(-(-over[k] * ranges // total))) for k, d in at.items())) - set(found)
        if not more:
            break
        found = sorted({*found, *more})
    return found


def given_places(sizes: dict[int, int], share: int, shards: int) -> tuple[dict[int, list[tuple[int, int]]], list[int]]:
    """For large groups the (end, shard) of each of their parts, in order, and the bytes that they take of each shard: the largest first, to the shard with the most room."""
    taken, places = [0] * shards, {}
    for group, left in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        end, parts = 0, []
        while left:
            shard = min(range(shards), key=lambda i: (taken[i], i))
            part = min(left, max(share - taken[shard], 1)) if left > share - taken[shard] else left
            end, left = end + part, left - part
            taken[shard] += part
            parts.append((end, shard))
        places[group] = parts
    return places, taken


def _mapped(of: dict[int, Column]) -> Column:
    return F.create_map(*[x for k, v in of.items() for x in (F.lit(k), v)])[F.col("_group")]


def assign_shards(records: DataFrame, group: Column, key: str, size: str, shards: int) -> DataFrame:
    """The records with shard (from 0) and slot (gapless from 0 in each shard).

    group: an integer hash; equal groups are kept together where they fit. key: an integer column.
    size: an integer column, at least 1. The records are written once, so pass ids and sizes, not texts.
    """
    kept = [c for c in records.columns if c not in ("shard", "slot")]
    place = F.xxhash64(F.monotonically_increasing_id())
    records = cut(records.select(*kept, group.alias("_group"), F.coalesce(F.col(key).cast("long"), F.lit(_LEAST)).alias("_key"), place.alias("_place"), F.col(size).cast("long").alias("_size")))
    total, n = records.agg(F.sum("_size"), F.count("*")).first()
    total, ranges = total or 1, max(shards * RANGES, -(-n // ROWS))
    parts = shards * LARGE
    large = {r[0]: int(r[1]) for r in records.groupBy("_group").agg(F.sum("_size").alias("s"), F.count("*").alias("c")).filter((F.col("c") > 1) & ((F.col("s") * parts > total) | (F.col("c") * parts > n))).select("_group", "s").collect()}
    is_large = F.col("_group").isin(*large) if large else F.lit(False)
    # ranges are of equal shares of bytes and rows together, so that very many small records spread too
    records = records.withColumns({"_weight": F.col("_size") / F.lit(float(total)) + F.lit(1 / max(n, 1)), "_small": F.when(is_large, 0).otherwise(F.col("_size"))})
    found = _splitters(records, 2.0, ranges, set(large))
    placed = records.withColumn("_range", _range_of(found))
    order, inside = Window.orderBy("_range"), Window.partitionBy("_range").orderBy(*_KEY)
    sums = placed.groupBy("_range").agg(F.sum("_size").alias("_s"), F.sum("_small").alias("_t"))
    before = sums.select("_range", (F.sum("_s").over(order) - F.col("_s")).alias("_size_before"), (F.sum("_t").over(order) - F.col("_t")).alias("_small_before"))
    running = inside.rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumns({"_at": F.coalesce(F.sum("_size").over(running), F.lit(0)), "_small_at": F.coalesce(F.sum("_small").over(running), F.lit(0)), "_new": F.coalesce(F.lag("_group").over(inside) != F.col("_group"), F.lit(True))})
    placed = placed.withColumn("_first", F.max(F.when(F.col("_new"), F.col("_small_at"))).over(inside.rowsBetween(Window.unboundedPreceding, 0)))  # where the record's group begins
    placed = placed.join(F.broadcast(before), "_range")  # one row for each range
    placed = cut(placed.select(*kept, *_KEY, "_range", (F.col("_at") + F.col("_size_before")).alias("_at"), (F.col("_first") + F.col("_small_before")).alias("_first")))
    share = -(-total // shards)
    places, taken = given_places(large, share, shards)
    room, ends = [max(0, share - t) for t in taken], []
    for r in room:
        ends.append((ends[-1] if ends else 0) + r)
    shard = F.least(F.lit(shards - 1), F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e <= F.col("_first"))))
    if large:
        begins = {r[0]: r[1] for r in placed.filter(is_large).groupBy("_group").agg(F.min("_at")).collect()}
        parts_of = _mapped({g: F.array(*[F.struct(F.lit(begins[g] + e).alias("end"), F.lit(i).alias("shard")) for e, i in p]) for g, p in places.items()})
        shard = F.when(is_large, F.filter(parts_of, lambda p: p["end"] > F.col("_at"))[0]["shard"]).otherwise(shard)
    placed = placed.withColumn("shard", shard.cast("int"))
    counts = placed.groupBy("_range", "shard").agg(F.count("*").alias("_c"))
    earlier = counts.select("_range", "shard", (F.sum("_c").over(Window.partitionBy("shard").orderBy("_range")) - F.col("_c")).alias("_earlier"))
    mine = Window.partitionBy("_range", "shard").orderBy(*_KEY)
    placed = placed.withColumn("_row", F.row_number().over(mine) - 1).join(F.broadcast(earlier), ["_range", "shard"])  # a row for each range and shard in it
    return placed.select(*kept, "shard", (F.col("_row") + F.col("_earlier")).cast("long").alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Per document its size (UTF-8 bytes and 1), the text's CRC, shard and slot; equal texts are a group."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("text_hash")
    )
    placed = assign_shards(slim, F.col("text_hash"), "doc_id", "size", shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast(T.IntegerType()).alias("grown_shard"))


def write_shards(docs: DataFrame, places: DataFrame, path: str) -> None:
    """Writes the documents by shard; places: doc_id and shard, doc_id a key."""
    docs.join(places.select("doc_id", "shard"), "doc_id").repartition("shard", F.pmod(F.xxhash64("doc_id"), F.lit(RANGES))).write.partitionBy("shard").parquet(path)
