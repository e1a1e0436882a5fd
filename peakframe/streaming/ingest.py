"""Structured Streaming over spectra and matches: an extension, as the batch operators per row and per group carry over.

Row-level operators are stateless and run as they are; the best match of a scan is a stateful aggregation with a
watermark; anything that needs the whole input runs in ``foreachBatch``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_parquet(spark: SparkSession, path: str, like: DataFrame, files: int = 1) -> DataFrame:
    """New Parquet files of a folder, with the schema of a batch table."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files).parquet(path)


def best_in_window(matches: DataFrame, time: str, keys: list[str], score: str, window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """The best match of each key and window of time; rows later than the watermark are dropped."""
    rest = [c for c in matches.columns if c not in {time, score, *keys}]
    best = F.max(F.struct(F.col(score), *[F.col(c) for c in rest])).alias("b")
    g = matches.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), *keys).agg(best)
    return g.select(F.col("w.start").alias("window_start"), *keys, "b.*")


def deduplicated(matches: DataFrame, time: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """The first row of each key within the watermark."""
    return matches.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def in_batches(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch through a batch operator into Parquet folders by batch, so that a repeated batch overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
