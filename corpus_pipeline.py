"""The corpus pipeline: stages that are written and read again one after another.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps, with the columns of
the documents table; the last returns pieces of packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from forgelens.llm import decontamination, line_dedup, near_duplicates, packing, quality
from forgelens.llm.queries import BYTE_BPE, table, tokenizer_path
from forgelens.llm.tables import drop, new_path, scratch


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; labels of the held-out part aren't learnt.

    Null and empty texts are scored like others, repeated rows alike; an empty table stays empty.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def without_repeated_runs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the runs of lines that repeat earlier ones; one of which nothing is left goes.

    Null, empty and blank texts stay; rows with equal doc_id and text are one and lose the same lines.
    """
    return line_dedup.without_emptied(line_dedup.drop_repeated_runs(docs))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates, from a similarity of 0.8; the bands miss a pair at just that with probability 1.3e-7.

    Null and blank texts are near nothing and stay, as rows without a doc_id do; of rows with equal doc_id and text one stays.
    """
    return near_duplicates.keep_one(docs, percent=80, bands=40, rows=5)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item; null and empty texts hold none."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences; a null text has its end id only."""
    return packing.pack(docs, tokenizer_path(BYTE_BPE), end_id=0)


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", without_repeated_runs),
    ("MinHash near-dedup", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("packing", packed),
]

#: A network's fit, sketches and a tokenizer aren't SQL; tests hold run() against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage cuts for itself goes once it is written, and its output once the next is; other results of the session stay."""
    docs, read = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        path = new_path(spark, "pipeline")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if read:
            drop(spark, read)
        docs, read = spark.read.parquet(path), path
    return docs
