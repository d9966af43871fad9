"""Transitive closure of groups that share members."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the folder that spark.checkpoint.dir names; a session on one machine without one gets a temporary folder."""
    context = df.sparkSession.sparkContext
    if not df.sparkSession.conf.get("spark.checkpoint.dir", None) and not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()


def components(members: DataFrame) -> DataFrame:
    """(node, component) of every node: the least node that it reaches over groups; members: node and group.

    Each round takes the least label of every group, for every node the least of its groups, and then the label
    of that label, so labels cross a component in a number of rounds like the logarithm of its width. Least values are taken by
    each task for its own rows first, and a group's one row meets its members in a join that Spark can
    split, so very large groups cost no more than their rows.
    """
    links = _cut(members.filter(F.col("node").isNotNull() & F.col("group").isNotNull()).select("node", "group").distinct())
    labels = _cut(links.select("node", F.col("node").alias("component")).distinct())
    whole = isinstance(labels.schema["component"].dataType, T.IntegralType)
    total = lambda rows: rows.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0]
    before = total(labels) if whole else None
    while True:
        least = links.join(labels, "node").groupBy("group").agg(F.min("component").alias("component"))
        near = _cut(links.join(least, "group").groupBy("node").agg(F.min("component").alias("component")))
        beyond = near.select(F.col("node").alias("component"), F.col("component").alias("further"))
        new = _cut(near.join(beyond, "component", "left").select("node", F.coalesce("further", "component").alias("component")))
        if whole:  # labels only fall, so they are the same when their sum is
            before, now = total(new), before
            changed = before != now
        else:
            changed = not new.join(labels, ["node", "component"], "left_anti").isEmpty()
        labels = new
        if not changed:
            return labels
