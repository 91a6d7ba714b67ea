"""Running totals over groups of any size.

Every group is cut into a fixed number of chunks.  Totals of the chunks make one small table (groups
times chunks rows) whose running totals start the chunks; inside a chunk a window adds up.  A group
with a third of all rows is thus dealt over as many tasks as it has chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Chunks of a group.
CHUNKS = 1024


def with_offsets(df: DataFrame, group: str, chunk: str, order: list[Column], size: str, offset: str) -> DataFrame:
    """``df`` with column ``offset``: the total of ``size`` over the rows before, within ``group``.

    Rows of a group follow each other by ``chunk`` (small non-null integers), then ``order``; rows that
    tie in all of these are told apart arbitrarily.  ``group`` has no nulls.
    """
    within = Window.partitionBy(group, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(group).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    starts = df.groupBy(group, chunk).agg(F.sum(size).alias("__total")).select(group, chunk, F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__start"))
    inner = df.withColumn(offset, F.coalesce(F.sum(size).over(within), F.lit(0)))
    return inner.join(starts, [group, chunk]).withColumn(offset, (F.col(offset) + F.col("__start")).cast("long")).drop("__start")
