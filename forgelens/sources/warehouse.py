"""The tables as Parquet folders below a root."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forgelens.config import Config
from forgelens.functions import sql as sql_functions
from forgelens.schemas import SCHEMAS, STATE, schema_of


class Warehouse:
    """Append, query and rewrite the six tables. One writer at a time; readers need no lock.

    A rewrite makes a new version of a table beside the old one and then points to it, so a reader
    that has begun keeps its files and a failed rewrite leaves the old version in place.
    """

    def __init__(self, spark: SparkSession, root: str, readonly: bool = False):
        self.spark, self.root, self.readonly = spark, root.rstrip("/"), readonly

    def __enter__(self) -> Warehouse:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        """Nothing is held open."""

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _writable(self) -> None:
        if self.readonly:
            raise RuntimeError("the warehouse is open read-only")

    def _version(self, table: str) -> str:
        """The newest version's folder; versions are named in ascending order."""
        schema_of(table)
        fs, path = self._fs(), self._path(table)
        names = sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []
        return f"{self.root}/{table}/{([n for n in names if n.startswith('v')] or ['v000000'])[-1]}"

    def create_tables(self) -> None:
        """Empty tables where there are none."""
        self._writable()
        for name, schema in (SCHEMAS | STATE).items():
            if not self._fs().exists(self._path(name)):
                self.spark.createDataFrame([], schema).write.parquet(f"{self.root}/{name}/v000000")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(schema_of(name)).parquet(self._version(name))

    def insert(self, name: str, rows: DataFrame | list[dict]) -> None:
        """Appends; columns that the table doesn't have are dropped, missing ones are null."""
        self._writable()
        schema = schema_of(name)
        if isinstance(rows, list):
            if not rows:
                return
            rows = self.spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema)
        have = set(rows.columns)
        rows.select([(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]).write.mode("append").parquet(self._version(name))

    def has_batch(self, batch: str) -> bool:
        return self.exists(f"{self.root}/_batches/{batch}/done")

    def insert_batch(self, batch: str, rows: dict[str, DataFrame]) -> None:
        """Appends to several tables under the name of a batch: again, it replaces what a broken attempt left, and does nothing once all tables have it."""
        self._writable()
        if self.has_batch(batch):
            return
        fs, jvm = self._fs(), self.spark._jvm.org.apache.hadoop.fs
        staged = {name: f"{self.root}/_batches/{batch}/{name}" for name in rows}
        for name, found in rows.items():
            found.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema_of(name)]).write.mode("overwrite").parquet(staged[name])
        for name, path in staged.items():
            table = self._version(name)
            for old in fs.globStatus(jvm.Path(f"{table}/batch-{batch}-*")) or []:
                fs.delete(old.getPath(), False)
            for i, part in enumerate(sorted(s.getPath().toString() for s in fs.globStatus(jvm.Path(f"{path}/part-*")) or [])):
                fs.rename(jvm.Path(part), jvm.Path(f"{table}/batch-{batch}-{i:05d}.parquet"))
        fs.create(self._path("_batches", batch, "done")).close()
        for path in staged.values():
            fs.delete(jvm.Path(path), True)

    def replace(self, name: str, rows: DataFrame) -> None:
        """A new version of the table from rows that may read the old one."""
        self._writable()
        current = self._version(name).rsplit("/v", 1)[1]
        temp = f"{self.root}/{name}/_new-{uuid.uuid4().hex}"
        rows.write.parquet(temp)
        self._fs().rename(self._path(name, temp.rsplit("/", 1)[1]), self._path(name, f"v{int(current) + 1:06d}"))

    def landed(self, run: str, what: str) -> str:
        """Where a run's answers to one question are landed."""
        return f"{self.root}/_landed/{run}/{what}"

    def drop_landed(self, run: str) -> None:
        """For a run that is finished."""
        self._fs().delete(self._path("_landed", run), True)

    def exists(self, path: str) -> bool:
        return self._fs().exists(self.spark._jvm.org.apache.hadoop.fs.Path(path))

    def tidy(self, keep: int = 2, open_runs: tuple[str, ...] | None = None) -> list[str]:
        """Deletes all versions but the newest ones, what failed rewrites left and, if open_runs are given, the landed answers of all other runs; returns what went. For times when nobody rewrites and no reader is at an older version."""
        self._writable()
        if keep < 1:
            raise ValueError("the newest version has to stay")
        fs, gone = self._fs(), []
        for table in SCHEMAS | STATE:
            path = self._path(table)
            names = sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []
            gone += [(table, n) for n in [n for n in names if n.startswith("v")][:-keep] + [n for n in names if n.startswith("_new-")]]
        if open_runs is not None and fs.exists(self._path("_landed")):
            names = (s.getPath().getName() for s in fs.listStatus(self._path("_landed")))
            gone += [("_landed", n) for n in sorted(names) if n not in open_runs]
        for parts in gone:
            fs.delete(self._path(*parts), True)
        return ["/".join(parts) for parts in gone]

    def query(self, sql: str, args: dict | None = None) -> DataFrame:
        """Spark SQL over the tables, with :name parameters and the functions of functions.sql."""
        sql_functions.register(self.spark)
        for name in SCHEMAS | {k: v for k, v in STATE.items() if self.exists(f"{self.root}/{k}")}:
            self.table(name).createOrReplaceTempView(name)
        return self.spark.sql(sql, args=args or {})

    def existing_shas(self) -> DataFrame:
        return existing_shas(self.table("commits"))

    def count(self, name: str) -> int:
        return self.table(name).count()


def open_warehouse(spark: SparkSession, config: Config) -> Warehouse:
    """The warehouse that the settings name."""
    if not config.warehouse:
        raise ValueError("the settings name no warehouse")
    return Warehouse(spark, config.warehouse, readonly=config.readonly)


def existing_shas(commits: DataFrame) -> DataFrame:
    return commits.select("commit_sha").distinct()


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row a table, from counts that are summed on the executors."""
    parts = [t.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows") for name, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
