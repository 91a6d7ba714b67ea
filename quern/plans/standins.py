"""The driver's tables in the roles of papers, mentions and specifications, in Spark and in SQL.

Orders are papers (their year and the customer's nation as field), line items are mentions of parts as
models, and parts are the specifications.  Nulls are planted by fixed rules of the keys.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F


@dataclass
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name`` with its SQL twin."""

    def put(f):
        REGISTRY[name] = Query(f, sql)
        return f

    return put


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


#: Bytes of a table's files whose rows meet in one task where they are dealt out by a key.
BYTES_PER_TASK = 4 << 20


def dealt(df: DataFrame, key: str, source: DataFrame) -> DataFrame:
    """``df`` dealt out by ``key`` to as many tasks as the files of ``source`` take, so that what a task holds
    stays the same however large they are; left to the planner where the cores would do."""
    tasks = -(-int(str(source._jdf.queryExecution().analyzed().stats().sizeInBytes())) // BYTES_PER_TASK)
    return df.repartition(tasks, key) if tasks > df.sparkSession.sparkContext.defaultParallelism else df


def papers(spark: SparkSession, d: str) -> DataFrame:
    """(paper, year, month, field, region_no, price, author)"""
    orders, customer, nation = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    orders = dealt(orders, "o_custkey", orders)
    people = customer.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("field"), F.col("n_regionkey").alias("region_no"))
    return orders.join(people, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("paper"), F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"), "field", "region_no", F.col("o_totalprice").alias("price"), F.col("o_custkey").alias("author"))


def specs(spark: SparkSession, d: str) -> DataFrame:
    """(model, display, vendor, segment, release_year, fp32, fp64, tensor, vram_gb, tdp)"""
    p = table(spark, d, "part")
    key, price = F.col("p_partkey"), F.col("p_retailprice")
    return p.select(
        key.alias("model"), F.col("p_name").alias("display"), F.col("p_brand").alias("vendor"), F.split("p_type", " ")[0].alias("segment"), F.when(key % 13 != 0, 1990 + F.col("p_size") % 9).cast("int").alias("release_year"),
        F.when(key % 5 != 0, price).alias("fp32"), F.when(key % 3 != 0, price / 2).alias("fp64"), F.when(key % 2 != 0, price * 4).alias("tensor"), F.when(key % 7 != 0, F.col("p_size").cast("double")).alias("vram_gb"), F.when(key % 11 != 0, (F.col("p_size") * 10).cast("double")).alias("tdp"),
    )


def mentions(spark: SparkSession, d: str) -> DataFrame:
    """(paper, mention, model, device_count, device_count_basis, memory_gb, usage_context, status)"""
    q = F.col("l_quantity").cast("bigint")
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("paper"), F.col("l_linenumber").alias("mention"), F.col("l_partkey").alias("model"), F.when(q % 7 != 0, F.when(q % 5 == 0, q * q * 8).otherwise(q)).alias("device_count"),
        F.when(F.col("l_linenumber") % 3 == 0, "inferred").otherwise("explicit").alias("device_count_basis"), F.when(F.col("l_suppkey") % 5 == 0, (F.col("l_suppkey") % 80).cast("double")).alias("memory_gb"),
        F.when(F.col("l_returnflag") == "N", "used-in-this-work").when(F.col("l_returnflag") == "A", "comparison-or-related-work").otherwise("object-of-study").alias("usage_context"), F.when(F.col("l_linestatus") == "F", F.when(F.col("l_linenumber") == 7, "truncated").otherwise("ok")).otherwise("ok").alias("status"),
    )


def used_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Mentions that are ok and used, with the paper's year."""
    return mentions(spark, d).where("status = 'ok' and usage_context = 'used-in-this-work'").join(papers(spark, d).select("paper", "year"), "paper")


def enriched(spark: SparkSession, d: str) -> DataFrame:
    """All mentions with year, field and the specification of the model."""
    return mentions(spark, d).join(papers(spark, d).select("paper", "year", "field"), "paper").join(specs(spark, d), "model", "left")


def observed(spark: SparkSession, d: str, of_paper: tuple[str, ...], of_model: tuple[str, ...], ok: bool = True) -> DataFrame:
    """Different (paper, model, of_paper, of_model) of the mentions, or of those that are ok, by model: pairs
    become different where their paper is, so that nothing but pairs is dealt out by model."""
    lines = table(spark, d, "lineitem")
    said = mentions(spark, d).where("status = 'ok'") if ok else mentions(spark, d)
    at_paper = lambda df: dealt(df, "paper", lines)
    at_model = lambda df: dealt(df, "model", lines)
    pairs = at_paper(said.select("paper", "model")).join(at_paper(papers(spark, d).select("paper", *of_paper)), "paper").distinct()
    return at_model(pairs).join(at_model(specs(spark, d).select("model", *of_model)).distinct(), "model", "left")


def observed_in_papers(spark: SparkSession, d: str, of_paper: tuple[str, ...], of_model: tuple[str, ...], ok: bool = True) -> DataFrame:
    """Different (paper, of_paper, of_model) of the mentions, or of those that are ok, by paper."""
    lines = table(spark, d, "lineitem")
    said = mentions(spark, d).where("status = 'ok'") if ok else mentions(spark, d)
    at_paper = lambda df: dealt(df, "paper", lines)
    at_model = lambda df: dealt(df, "model", lines)
    named = at_model(said.select("paper", "model")).join(at_model(specs(spark, d)), "model", "left").select("paper", *of_model)
    return at_paper(named).join(at_paper(papers(spark, d).select("paper", *of_paper)), "paper").distinct()


PRELUDE = """
papers AS (
  SELECT o_orderkey AS paper, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, n_name AS field, n_regionkey AS region_no, o_totalprice AS price, o_custkey AS author
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
specs AS (
  SELECT p_partkey AS model, p_name AS display, p_brand AS vendor, split_part(p_type, ' ', 1) AS segment, CASE WHEN p_partkey % 13 <> 0 THEN CAST(1990 + p_size % 9 AS INTEGER) END AS release_year,
         CASE WHEN p_partkey % 5 <> 0 THEN p_retailprice END AS fp32, CASE WHEN p_partkey % 3 <> 0 THEN p_retailprice / 2 END AS fp64, CASE WHEN p_partkey % 2 <> 0 THEN p_retailprice * 4 END AS tensor,
         CASE WHEN p_partkey % 7 <> 0 THEN CAST(p_size AS DOUBLE) END AS vram_gb, CASE WHEN p_partkey % 11 <> 0 THEN CAST(p_size * 10 AS DOUBLE) END AS tdp
  FROM part),
mentions AS (
  SELECT l_orderkey AS paper, l_linenumber AS mention, l_partkey AS model,
         CASE WHEN CAST(l_quantity AS BIGINT) % 7 <> 0 THEN CASE WHEN CAST(l_quantity AS BIGINT) % 5 = 0 THEN CAST(l_quantity AS BIGINT) * CAST(l_quantity AS BIGINT) * 8 ELSE CAST(l_quantity AS BIGINT) END END AS device_count,
         CASE WHEN l_linenumber % 3 = 0 THEN 'inferred' ELSE 'explicit' END AS device_count_basis, CASE WHEN l_suppkey % 5 = 0 THEN CAST(l_suppkey % 80 AS DOUBLE) END AS memory_gb,
         CASE l_returnflag WHEN 'N' THEN 'used-in-this-work' WHEN 'A' THEN 'comparison-or-related-work' ELSE 'object-of-study' END AS usage_context, CASE WHEN l_linestatus = 'F' AND l_linenumber = 7 THEN 'truncated' ELSE 'ok' END AS status
  FROM lineitem),
used AS (SELECT m.*, p.year FROM mentions m JOIN papers p USING (paper) WHERE status = 'ok' AND usage_context = 'used-in-this-work'),
enriched AS (SELECT m.*, p.year, p.field, s.display, s.vendor, s.segment, s.release_year, s.fp32, s.fp64, s.tensor, s.vram_gb, s.tdp FROM mentions m JOIN papers p USING (paper) LEFT JOIN specs s USING (model))"""


def twin(body: str, more: str = "") -> str:
    """SQL over the stand-ins; ``more``: further common tables."""
    return f"WITH RECURSIVE {PRELUDE}{', ' + more if more else ''} {body}"


#: (year, q) by the nearest rank, in SQL: the element at place round((n - 1) q), halves upwards.
def nearest_sql(source: str, by: str, value: str, q: float, out: str) -> str:
    return f"""SELECT {by}, {value} AS {out} FROM (
      SELECT {by}, {value}, row_number() OVER (PARTITION BY {by} ORDER BY {value}) - 1 AS k, count(*) OVER (PARTITION BY {by}) AS n FROM {source} WHERE {value} IS NOT NULL)
      WHERE k = CAST(floor((n - 1) * {q} + 0.5) AS BIGINT)"""
