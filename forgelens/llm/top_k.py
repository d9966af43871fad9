"""Exact top-k search by inner product of quantised vectors.

Queries are dealt into blocks and candidates into shards of a bounded number of bytes each, by hash;
every pair of a block and a shard is a task's group (a cogroup: queries are repeated for each shard,
candidates for each block, which costs no more than the product that has to be done). A group takes its
candidates in tiles, a matrix product each, keeps each query's best of a tile by partial selection and
merges them. The groups' lists are merged as a tree: within a lane of a query first, then over lanes.
Nothing is broadcast or collected but two sums.

A component x becomes floor(256 x). Products are exact: in double precision where the bounds of the
tile allow it (every partial sum below 2 ** 53), else in Python integers; a score outside 64 bits
takes the nearest bound.

Defined results: vectors that are null or hold null, NaN or infinity take no part, as rows without a
vec_id; only vectors of equal length are compared; equal scores go to the smaller vec_id; equal rows count once; a query
has fewer than k rows if there are fewer candidates; if a vec_id repeats, its rows are queries and
candidates each, but never of one another, and its lists are merged into one in which a candidate's
best score counts; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bytes of a block of queries and of a shard of candidates, shards at least (so that small tables spread too), scores in a tile, lanes of the first merge.
BLOCK_BYTES, SHARD_BYTES, SHARDS, TILE, LANES = 8 << 20, 16 << 20, 32, 1 << 22, 8

SCHEMA = "query_id long, vec_id long, score long"


def usable(vectors: DataFrame, vector: str) -> DataFrame:
    """vec_id and the vector as doubles, of rows that take part."""
    v = F.col(vector).cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    return rows.filter("vec_id is not null and v is not null").filter(F.forall("v", finite))


def _quantised(column: pa.Array, width: int) -> np.ndarray:
    return np.floor(256.0 * column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width))


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    if np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * q.shape[1] < 2**53:
        return (q @ c.T).astype(np.int64)
    as_ints = [np.array([[int(x) for x in row] for row in m], object).reshape(m.shape) for m in (q, c)]
    return np.clip(as_ints[0].dot(as_ints[1].T), -(1 << 63), (1 << 63) - 1).astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each query's k best candidates of a tile whose ids ascend; own: ids of the queries."""
    others = ids[None, :] != own[:, None]
    n = scores.shape[1]
    if n <= k:
        return np.nonzero(others)
    least = np.where(others, scores, np.iinfo(np.int64).min)
    bar = np.partition(least, n - k, axis=1)[:, n - k, None]
    above = least > bar
    level = (least == bar) & others
    level &= np.cumsum(level, axis=1) <= k - above.sum(axis=1, keepdims=True)  # the smallest ids first
    return np.nonzero(above | level)


def _search(q: pa.Table, c: pa.Table, k: int) -> pa.Table:
    """Each query's best of a shard; columns vec_id and v."""
    found = []
    if q.num_rows and c.num_rows:
        q, c = q.combine_chunks(), c.sort_by("vec_id").combine_chunks()
        own, width = q.column("vec_id").to_numpy(), len(q.column("v")[0])
        step = max(1, min(TILE // q.num_rows, c.num_rows))
        queries = _quantised(q.column("v").combine_chunks(), width)
        for at in range(0, c.num_rows, step):
            tile = c.slice(at, step)
            ids = tile.column("vec_id").to_numpy()
            scores = _products(queries, _quantised(tile.column("v").combine_chunks(), width))
            row, col = _best(scores, ids, own, k)
            found.append((row, ids[col], scores[row, col]))
    row, ids, scores = (np.concatenate(x) for x in zip(*found)) if found else [np.zeros(0, np.int64)] * 3
    order = np.lexsort((ids, ~scores, row))
    row, ids, scores = row[order], ids[order], scores[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    row, ids, scores = row[rank < k], ids[rank < k], scores[rank < k]
    return pa.table({"query_id": pa.array(own[row] if found else row, pa.int64()), "vec_id": pa.array(ids, pa.int64()), "score": pa.array(scores, pa.int64())})


def _merged(lists: DataFrame, k: int, *keys: str | Column) -> DataFrame:
    order = Window.partitionBy("query_id", *keys).orderBy(F.desc("score"), "vec_id")
    return lists.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 5, vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best vectors other than itself."""
    sides = [usable(t, vector).distinct() for t in (queries, vectors)]
    size = lambda t: usable(t, vector).agg(F.coalesce(F.sum(F.size("v") * 8 + 16), F.lit(0))).first()[0]
    blocks, shards = max(1, -(-size(queries) // BLOCK_BYTES)), max(SHARDS, -(-size(vectors) // SHARD_BYTES))
    part = lambda n: F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = sides[0].select("vec_id", "v", F.size("v").alias("width"), part(blocks).alias("block"), every(shards).alias("shard"))
    c = sides[1].select("vec_id", "v", F.size("v").alias("width"), every(blocks).alias("block"), part(shards).alias("shard"))
    key = ("width", "block", "shard")
    lists = q.groupBy(*key).cogroup(c.groupBy(*key)).applyInArrow(lambda a, b: _search(a, b, k), SCHEMA)
    lists = lists.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    lane = F.pmod(F.xxhash64("vec_id"), F.lit(LANES))
    return _merged(_merged(lists.withColumn("lane", lane), k, "lane"), k).select("query_id", "rank", "vec_id", "score")
