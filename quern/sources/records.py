"""Full-text records in JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quern.functions import text as tx

BODY = "corpusid bigint, body struct<text:string,annotations:struct<paragraph:string,section_header:string>>"


def read_records(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Records of plain or compressed JSON lines; lines that do not parse are dropped."""
    out = spark.read.schema(BODY).option("mode", "DROPMALFORMED").json(path)
    return out.limit(limit) if limit is not None else out


def record_paragraphs(records: DataFrame) -> DataFrame:
    """(paper_id, idx, start, end, text, section) of records: by spans where there are any, else
    between blank lines."""
    text = F.col("body.text")
    spans, headers = tx.span_array(F.col("body.annotations.paragraph")), tx.span_array(F.col("body.annotations.section_header"))
    fallback = F.transform(tx.split_paragraphs(text, "\n\n"), lambda p: F.struct(p["idx"].alias("idx"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), p["text"].alias("text"), F.lit(None).cast("string").alias("section")))
    made = F.when(F.size(spans) > 0, tx.spans_to_paragraphs(text, spans, headers)).otherwise(fallback)
    return records.where(text.isNotNull()).select(F.col("corpusid").cast("string").alias("paper_id"), F.inline(made))


def record_papers(records: DataFrame) -> DataFrame:
    """(paper_id, corpusid, body_chars) of all records, with or without a body."""
    return records.select(F.col("corpusid").cast("string").alias("paper_id"), "corpusid", F.coalesce(F.length("body.text"), F.lit(0)).alias("body_chars"))
