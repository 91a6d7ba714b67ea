"""Specification sheets as dimension rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quern.functions import text as tx

SHEET = "name string, manufacturer string, release string, fp32_flops string, fp64_flops string, memory_bytes string, tdp_w string"


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """CSV sheet with a header; unknown columns are left out, numbers stay text until they are read."""
    raw = spark.read.option("header", True).csv(path)
    wanted = [c.split()[0] for c in SHEET.split(", ")]
    return raw.select(*[F.col(c) if c in raw.columns else F.lit(None).cast("string").alias(c) for c in wanted])


def merge_variants(sheet: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One row per device: earliest release, largest of each specification (FLOP/s as GFLOPS, bytes as
    GB).  Rows without a date, rows that name several variants, and ids in ``known`` are left out."""
    number = lambda c, scale: tx.largest_number(F.col(c)) / scale
    rows = sheet.where(~F.coalesce(F.col("name").contains("/"), F.lit(True))).select(
        tx.slug(F.col("name")).alias("id"), tx.collapse(F.col("name")).alias("display"), "manufacturer", tx.release_month(F.col("release")).alias("release"),
        number("fp32_flops", 1e9).alias("fp32_gflops"), number("fp64_flops", 1e9).alias("fp64_gflops"), number("memory_bytes", 1e9).alias("vram_gb"), number("tdp_w", 1).alias("tdp_w"),
    ).where("release is not null and id <> ''")
    merged = rows.groupBy("id").agg(F.min("display").alias("display"), F.min("manufacturer").alias("manufacturer"), F.min("release").alias("release"), *[F.max(c).alias(c) for c in ("fp32_gflops", "fp64_gflops", "vram_gb", "tdp_w")])
    return merged if known is None else merged.join(known.select("id"), "id", "left_anti")
