"""Landed API files as a stream into the warehouse."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from forgelens.schemas import schema_of
from forgelens.sources.forge import not_stored
from forgelens.sources.warehouse import Warehouse


def _near(rows: DataFrame, stored: DataFrame, column: str) -> DataFrame:
    """The stored rows between the least and greatest value that the rows have in the column; Parquet skips the row groups outside."""
    low, high = rows.agg(F.min(column).cast("string"), F.max(column).cast("string")).first()
    kind = stored.schema[column].dataType
    return stored.filter(F.col(column).between(F.lit(low).cast(kind), F.lit(high).cast(kind)) | F.col(column).isNull())


def ingest(
    spark: SparkSession, landed: str, schema: str, project: Callable[[DataFrame], DataFrame], warehouse: Warehouse, table: str, keys: tuple[str, ...], checkpoint: str, within: str | None = None
) -> StreamingQuery:
    """All files that are there and not yet taken, by taken()."""
    stream = spark.readStream.schema(schema).option("multiLine", True).json(landed)
    return taken(stream, project, warehouse, table, keys, checkpoint, within)


def taken(stream: DataFrame, project: Callable[[DataFrame], DataFrame], warehouse: Warehouse, table: str, keys: tuple[str, ...], checkpoint: str, within: str | None = None) -> StreamingQuery:
    """What a stream has so far (landed files, or a forge itself), into a table. Rows whose keys the table has are left out, so a batch that is tried again, or overlaps another, adds nothing twice.

    within: a column in which rows with equal keys are equal (a commit's committed_date), so that only the table's part between a batch's least and greatest value is compared.
    """
    if within is not None:
        schema_of(table)[within]

    def take(batch: DataFrame, _: int) -> None:
        rows = project(batch).dropDuplicates(list(keys)).persist()
        stored = warehouse.table(table)
        warehouse.insert(table, not_stored(rows, stored if within is None else _near(rows, stored, within), *keys))
        rows.unpersist()

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
