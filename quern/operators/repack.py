"""Equal shards in a global order, without a window over the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import AtomicType

from quern.checkpoint import checkpointed


def shard_rows(df: DataFrame, order: list[str], shard_rows: int, ranges: int | None = None) -> DataFrame:
    """``df`` with ``shard``: rows in ascending ``order``, ``shard_rows`` to a shard.

    The table is cut into ranges of the order; a row's place is the rows of the ranges before plus its
    place in its own.  Only one count per range meets in one task.  The ranges are written once: they come
    from a sample, and cut twice they would differ.  Rows that tie in the order stand by their other plain
    columns, so that shards don't depend on how the rows arrive.
    """
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = checkpointed(df.repartitionByRange(ranges, *order).withColumn("__range", F.spark_partition_id()))
    counts = placed.groupBy("__range").agg(F.count("*").alias("__n"))
    starts = counts.withColumn("__start", F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    rest = [f.name for f in df.schema.fields if f.name not in order and isinstance(f.dataType, AtomicType)]
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*order, *rest)) - 1
    return placed.withColumn("__place", place).join(starts, "__range").withColumn("shard", F.floor((F.col("__start") + F.col("__place")) / shard_rows)).drop("__range", "__place", "__start")
