"""Recall of a lexicon on sentences whose devices were marked by hand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quern.operators.lexicon import Lexicon
from quern.operators.matching import gated, unresolved_bucket, with_matches

# Fixed value: the label of the spans that count.
DEVICE_LABEL = "hardware-device"


def gold_spans(label: Column, wanted: str = DEVICE_LABEL) -> Column:
    """(start, end) of the entries [start, end, label] with the wanted label in any case; null: none."""
    mine = F.filter(F.coalesce(label, F.array()), lambda x: F.lower(F.get(x, F.lit(2))) == wanted)
    return F.transform(mine, lambda x: F.struct(F.get(x, F.lit(0)).try_cast("int").alias("start"), F.get(x, F.lit(1)).try_cast("int").alias("end")))


def gold_sentences(spark: SparkSession, path: str) -> DataFrame:
    """(paper_id, text, gold) of JSON lines (text, label, Comments.paper_id); an unknown paper is '?'."""
    raw = spark.read.schema("text string, label array<array<string>>, Comments struct<paper_id:string>").json(path)
    return raw.select(F.coalesce("Comments.paper_id", F.lit("?")).alias("paper_id"), "text", gold_spans(F.col("label")).alias("gold"))


def judged_spans(sentences: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(paper_id, surface, local, rescued, as_model, bucket) of every gold span.

    Matches and spans stand in one row, so they are compared without a join.  A paper with an ungated model
    rescues its gated matches.  The bucket is null for spans that are found."""
    found = with_matches(sentences, "text", lexicon).withColumn("matches", gated(F.col("matches"), F.col("text"), lexicon))
    anchor = F.bool_or(F.exists("matches", lambda m: (m["kind"] == "model") & ~m["gate_required"])).alias("anchored")
    rows = found.join(found.groupBy("paper_id").agg(anchor), "paper_id")
    ok = lambda m: ~m["gate_required"] | m["gate_ok"]
    spans = rows.select("paper_id", "text", "matches", "anchored", F.explode("gold").alias("g"))
    meets = lambda m: (m["start"] < F.col("g.end")) & (F.col("g.start") < m["end"])
    surface = F.trim(F.substring(F.col("text"), F.col("g.start") + 1, F.col("g.end") - F.col("g.start")))
    kept = lambda m: meets(m) & (ok(m) | F.col("anchored"))
    out = spans.select("paper_id", surface.alias("surface"), F.exists("matches", lambda m: meets(m) & ok(m)).alias("local"), F.exists("matches", kept).alias("rescued"), F.exists("matches", lambda m: kept(m) & (m["kind"] == "model")).alias("as_model"))
    return out.withColumn("bucket", F.when(~F.col("rescued"), unresolved_bucket(F.col("surface"))))


def recall(spans: DataFrame) -> DataFrame:
    """One row: spans, and shares found in their own context, with rescue, and as a model."""
    share = lambda c: F.avg(F.col(c).cast("int")).alias(c)
    return spans.agg(F.count("*").alias("spans"), share("local"), share("rescued"), share("as_model"))


def misses(spans: DataFrame) -> DataFrame:
    """(bucket, n, share of all spans) of the spans that are not found."""
    total = spans.agg(F.count("*").alias("total"))
    return spans.where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n")).join(F.broadcast(total)).select("bucket", "n", (F.col("n") / F.col("total")).alias("share"))
