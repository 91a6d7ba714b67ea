"""Restartable ingestion, and event-time extensions.

A checkpointed file stream with trigger ``availableNow`` takes what is new since the last run and stops:
running the command again does what is left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F


def ingest_new(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df, format: str = "parquet") -> int:
    """Process the files that are new below ``source`` into Parquet at ``target``; returns its rows so
    far.  A file that was taken is never taken again under its name."""
    stream = spark.readStream.format(format).schema(schema).load(source)
    run = transform(stream).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(target).count()


def run_to_end(result: DataFrame, target: str, checkpoint: str) -> DataFrame:
    """Run an aggregated stream over what there is; every trigger replaces the table at ``target``."""
    query = result.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(target)).start().awaitTermination()
    return result.sparkSession.read.schema(result.schema).parquet(target)


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Extension: counts per key and tumbling window, with late events up to the watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def without_repeats(events: DataFrame, time: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Extension: first event of each key within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
