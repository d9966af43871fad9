"""Tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. A session on one machine that has none gets a temporary folder; one on a cluster has to name it, as its executors don't share the driver's."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "local").split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Where tables of a scratch() are cut; None: in the application's own folder.
_SCRATCH: ContextVar[str | None] = ContextVar("scratch", default=None)


def new_path(spark: SparkSession, kind: str = "tables") -> str:
    """A place for one table below this application's folder."""
    return f"{shared_folder(spark)}/{spark.conf.get('spark.app.id', 'application')}/{kind}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The rows, written once and read again: later work starts from the files, also after executors are lost."""
    folder = _SCRATCH.get()
    path = f"{folder}/{uuid.uuid4().hex}" if folder else new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a folder with all that is in it."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001 - Spark's Python API deletes no files
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)  # noqa: SLF001


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Tables that are cut inside go to a folder of their own, which goes at the end: write a result that reads them before. Other tables stay."""
    path = new_path(spark, "scratch")
    held = _SCRATCH.set(path)
    try:
        yield path
    finally:
        _SCRATCH.reset(held)
        drop(spark, path)
