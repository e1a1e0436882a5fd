"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's documents.

Toxic documents go, then those that fail the quality rules, then all but one of each group of near copies;
secrets are masked in what is left, and the result is packed into training sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from peakframe.llm import jaccard_join, packing, quality, secret_scan, toxicity
from peakframe.llm.common import read, scratch
from peakframe.llm.queries import vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs, quality.fit(docs, read(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_low_quality),
    ("jaccard_join", drop_near_copies),
    ("secret_scans", mask_secrets),
    ("packing", pack),
]

#: Learned models, connected components and tokenizers aren't SQL; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def _drop(spark: SparkSession, path: str) -> None:
    """Remove a folder in whatever store it is."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's table goes once the next one is written."""
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            _drop(spark, before)
        before = path
    return docs
