"""Connected components of an edge table by alternating large-star / small-star contraction.

Every round is two aggregations and joins over the edges; nothing is gathered on the driver but a
checksum per round.  The neighbourhood minimum is a plain aggregation (combined before the shuffle)
that is joined back, so that a hub with a third of all edges is split by the skew join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quern.llm.storage import drop_folder, write_table


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One contraction step over edges (u, v): every neighbour is linked to the least one."""
    if small:
        # Only neighbours below the node: node and neighbours all hang on the least of them.
        directed = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = directed.groupBy("u").agg(F.min("v").alias("m"))
        moved = directed.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.union(least.select("u", F.col("m").alias("v"))).distinct()
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def components(edges: DataFrame, left: str, right: str, max_rounds: int = 60, rows: int | None = None) -> DataFrame:
    """Components of the graph with an edge for every row of ``edges``.

    Returns (node, component) for each node that has an edge to another node; ``component`` is the
    least node of its component.  Null ends and loops are ignored; an empty edge table gives an
    empty result.  ``max_rounds`` only guards against a defect: the contraction needs about
    log2(longest path) rounds and an unfinished one raises.  ``rows``: about how many edges there are,
    where the table of each round should have no more files than they take (see ``write_table``).
    """
    spark = edges.sparkSession
    now = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u <> v").distinct()
    path = write_table(now, "cc", rows=rows)
    schema = now.schema
    last = None
    for _ in range(max_rounds):
        now = _star(_star(spark.read.schema(schema).parquet(path), small=False), small=True)
        following = write_table(now, "cc", rows=rows)
        drop_folder(spark, path)
        path = following
        now = spark.read.schema(schema).parquet(path)
        # The rounds end when the set of edges stays as it is.
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if mark == last:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        last = mark
    raise RuntimeError("connected components did not settle")
