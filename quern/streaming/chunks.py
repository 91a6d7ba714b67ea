"""Chunked work that goes on where it stopped."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def chunk_of(key: str, chunks: int) -> Column:
    """The chunk of a row: its key decides, so the same row falls into the same chunk in every run."""
    return F.pmod(F.xxhash64(key), F.lit(chunks)).cast("int")


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def run_missing(work: DataFrame, key: str, chunks: int, out: str, make: Callable[[DataFrame], DataFrame], at_once: int = 64) -> int:
    """Write ``make(rows)``, which keeps ``key``, below ``out``/data by chunks; returns the chunks that ran.

    A ledger takes a chunk after its data are committed, and a chunk that is not in it is made anew and
    replaces what a broken run left.  ``work`` is read once for every ``at_once`` chunks: pass a written
    table.  A ledger of another number of chunks is an error."""
    spark = work.sparkSession
    data, ledger = f"{out}/data", f"{out}/ledger"
    done: set[int] = set()
    if exists(spark, ledger):
        rows = spark.read.schema("chunk int, chunks int").parquet(ledger).distinct().collect()
        if any(r["chunks"] != chunks for r in rows):
            raise ValueError(f"{out} was begun with another number of chunks")
        done = {r["chunk"] for r in rows}
    left = [c for c in range(chunks) if c not in done]
    for at in range(0, len(left), at_once):
        some = left[at : at + at_once]
        made = make(work.where(chunk_of(key, chunks).isin(some))).withColumn("chunk", chunk_of(key, chunks))
        made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chunk").parquet(data)
        spark.createDataFrame([(c, chunks) for c in some], "chunk int, chunks int").coalesce(1).write.mode("append").parquet(ledger)
    return len(left)


def usable_rows(df: DataFrame, columns: list[str], ids: DataFrame | None = None, on: str = "corpusid", text: str | None = None, least_chars: int = 20) -> DataFrame:
    """The columns of rows whose id is asked for and whose text has more than ``least_chars`` characters:
    columns, filter and semi-join reach the scan."""
    out = df if text is None else df.where(F.length(text) > least_chars)
    return (out if ids is None else out.join(ids.select(on), on, "left_semi")).select(*columns)


def first_parts(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The first ``n`` files of a Parquet folder by name, for a trial run."""
    return spark.read.parquet(*sorted(spark.read.parquet(path).inputFiles())[:n])


def write_parameters(spark: SparkSession, path: str, facts: dict) -> None:
    """One line of JSON with sorted names: what a product was made from."""
    spark.createDataFrame([(json.dumps(facts, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)
