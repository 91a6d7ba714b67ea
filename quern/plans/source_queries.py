"""Queries of generated lexicons, specification tables, panels with a corpus, and evaluation."""

from __future__ import annotations

import uuid

from pyspark.sql import Window, functions as F

from quern.checkpoint import shared_folder
from quern.functions.text import slug
from quern.operators import aliases, encode, evaluation, matching, panels
from quern.plans.standins import enriched, mentions, observed, papers, query, specs, table, twin
from quern.plans.text_queries import _PLANTED_SQL, _in_sql, _planted
from quern.sources import html_tables
from quern.streaming import ingest

# ---- specification tables --------------------------------------------------------------------

#: Pages that one task reads.
PAGES_PER_TASK = 10_000


def _spec_pages(spark, d):
    """One page per part with a table: name, rates in TFLOPS, memory in MB, power with a footnote."""
    p = table(spark, d, "part")
    # A page takes far longer to read than the few bytes of its part in the file tell.
    p = p.repartition(-(-p.count() // PAGES_PER_TASK) or 1, "p_partkey")
    head = "<h2>Parts</h2><h3>List</h3><table class='wikitable'><tr><th rowspan=\"2'\">Model</th><th colspan=\"2 \">Processing power (TFLOPS)</th><th>Memory size (MB)</th><th>TDP</th></tr><tr><th>Single</th><th>Tensor sparse</th><th></th><th></th></tr><tr><td>"
    row = F.concat(F.lit(head), F.concat(F.lit("Part "), "p_partkey", F.lit("</td><td>")), F.col("p_size"), F.lit(" / 0.5</td><td>9</td><td>"), F.col("p_size") * 1024, F.lit("</td><td>"))
    power = F.when(F.col("p_partkey") % 5 == 0, "TBA").otherwise(F.concat(F.col("p_size") * 10, F.lit(" [3]")))
    return p.select("p_partkey", F.concat(row, power, F.lit("</td></tr></table>")).alias("html"))


@query("spec_tables", "SELECT p_partkey, 'Part ' || p_partkey AS name, CAST(greatest(p_size, 0.5) * 1000 AS DOUBLE) AS fp32_gflops, CAST(p_size AS DOUBLE) AS vram_gb, CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_size * 10 AS DOUBLE) END AS tdp_w FROM part")
def spec_tables(spark, d):
    rows = html_tables.table_rows(_spec_pages(spark, d), "p_partkey", "html", "wikitable")
    return html_tables.specifications(rows, "p_partkey").select("p_partkey", "name", "fp32_gflops", "vram_gb", "tdp_w")


@query("span_repair", """SELECT p_partkey, '<td colspan="' || p_size || '" rowspan="1">x</td>' AS html FROM part""")
def span_repair(spark, d):
    raw = F.concat(F.lit('<td colspan="'), F.col("p_size"), F.lit("' \" rowspan=\"x\">x</td>"))
    return table(spark, d, "part").select("p_partkey", html_tables.repaired_spans(raw).alias("html"))


@query("page_links", r"SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\">', 1)) AS href FROM pages")
def page_links(spark, d):
    links = F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)">'), F.lit(1))
    return table(spark, d, "pages").select("page_id", F.explode(links).alias("href"))


# ---- aliases ---------------------------------------------------------------------------------


def _devices(spark, d):
    code = F.concat(F.lit("K"), F.col("p_partkey"))
    return table(spark, d, "part").select(F.format_string("%08d", "p_partkey").alias("id"), F.concat(F.lit("Tesla "), code, F.lit(" 16 GB (PCIe)")).alias("name"), F.lit("NVIDIA").alias("vendor"))


@query("alias_generation", """WITH n AS (SELECT lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS id, 'K' || p_partkey AS code FROM part)
 SELECT id, 'Tesla ' || code AS form, NULL AS gate, 'insensitive' AS kind FROM n UNION ALL SELECT id, 'NVIDIA Tesla ' || code, NULL, 'insensitive' FROM n UNION ALL SELECT id, 'NVIDIA ' || code, NULL, 'insensitive' FROM n
 UNION ALL SELECT id, code, CASE WHEN length(code) < 6 THEN 'gpu' END, 'auto' FROM n""")
def alias_generation(spark, d):
    return aliases.make_aliases(_devices(spark, d)).select("id", "form", "gate", F.col("case").alias("kind"))


@query("coverage_forms", "SELECT p_partkey, 'Tesla K' || p_partkey || 'c 80 GB,Tesla K' || p_partkey || 'c' || CASE WHEN length(CAST(p_partkey AS VARCHAR)) BETWEEN 2 AND 4 THEN ',Tesla K' || p_partkey ELSE '' END AS forms FROM part")
def coverage_forms(spark, d):
    name = F.concat(F.lit("Tesla K"), "p_partkey", F.lit("c 80 GB"))
    return table(spark, d, "part").select("p_partkey", F.array_join(aliases.coverage_forms(name), ",").alias("forms"))


@query("id_collisions", "WITH n AS (SELECT DISTINCT trim(regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g'), '-') || '-' || c_nationkey || '-' || c_custkey % 4 AS id FROM customer), t AS (SELECT DISTINCT trim(regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g'), '-') || CASE WHEN c_custkey % 2 = 0 THEN '-' || c_nationkey ELSE '-' || c_nationkey || '-' || c_custkey % 4 || '-x' END AS id FROM customer WHERE c_custkey % 3 = 0) SELECT id FROM n WHERE EXISTS (SELECT 1 FROM t WHERE n.id = t.id OR starts_with(n.id, t.id || '-') OR starts_with(t.id, n.id || '-'))")
def id_collisions(spark, d):
    c = table(spark, d, "customer").withColumn("s", slug(F.col("c_name"))).withColumn("last", (F.col("c_custkey") % 4).cast("string"))
    taken = c.where("c_custkey % 3 = 0").select(F.when(F.col("c_custkey") % 2 == 0, F.concat_ws("-", "s", "c_nationkey")).otherwise(F.concat_ws("-", "s", "c_nationkey", "last", F.lit("x"))).alias("id")).distinct()
    return aliases.colliding(c.select(F.concat_ws("-", "s", "c_nationkey", "last").alias("id")).distinct(), taken)


# ---- panels ----------------------------------------------------------------------------------


@query("two_vendor_by_field", twin("SELECT field, count(DISTINCT paper) FILTER (WHERE vendor = 'Brand#11') AS v11, count(DISTINCT paper) FILTER (WHERE vendor = 'Brand#22') AS v22 FROM enriched WHERE vendor IN ('Brand#11', 'Brand#22') AND field IN (SELECT field FROM enriched WHERE vendor IN ('Brand#11', 'Brand#22') GROUP BY field ORDER BY count(DISTINCT paper) DESC, field LIMIT 20) GROUP BY field"))
def two_vendor_by_field(spark, d):
    e = enriched(spark, d).where(F.col("vendor").isin("Brand#11", "Brand#22"))
    top = e.groupBy("field").agg(F.countDistinct("paper").alias("n")).orderBy(F.desc("n"), "field").limit(20)
    kept = e.join(top, "field", "left_semi")
    return kept.groupBy("field").pivot("vendor", ["Brand#11", "Brand#22"]).agg(F.countDistinct("paper")).na.fill(0).withColumnsRenamed({"Brand#11": "v11", "Brand#22": "v22"})


@query("model_by_field", twin("SELECT model, field, count(*) AS n FROM enriched GROUP BY model, field"))
def model_by_field(spark, d):
    """The counts of the model by field matrix in long form, which stays whole at any number of models."""
    return enriched(spark, d).groupBy("model", "field").agg(F.count("*").alias("n"))


@query("enriched_mentions", twin("SELECT m.paper, m.mention, m.usage_context, p.year, p.field FROM mentions m LEFT JOIN papers p USING (paper) WHERE m.usage_context IN ('used-in-this-work', 'comparison-or-related-work')"))
def enriched_mentions(spark, d):
    kept = mentions(spark, d).where(F.col("usage_context").isin("used-in-this-work", "comparison-or-related-work"))
    return kept.join(papers(spark, d).select("paper", "year", "field"), "paper", "left").select("paper", "mention", "usage_context", "year", "field")


@query("stack_share_by_year", f"WITH {_PLANTED_SQL}, y AS (SELECT doc_id, 2000 + doc_id % 5 AS year, regexp_matches(text, {_in_sql('CUDA|cuDNN|cuBLAS|nvcc', False)}) AS cuda FROM planted WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) SELECT year, count(*) AS n, round(avg(CASE WHEN cuda THEN 1 ELSE 0 END), 6) AS cuda FROM y GROUP BY year")
def stack_share_by_year(spark, d):
    docs = _planted(spark, d).join(table(spark, d, "labels").where("quality = 1"), "doc_id", "left_semi").withColumn("year", 2000 + F.col("doc_id") % 5)
    return panels.share_by(docs, ["year"], F.col("text").rlike(matching.STACK_PATTERNS["cuda"]), "cuda").withColumn("cuda", F.round("cuda", 6))


@query("adoption_after_release", twin("SELECT model, CAST(min(release_year) AS INTEGER) AS release_year, CAST(min(year) FILTER (WHERE cum >= 1) - min(release_year) AS INTEGER) AS lag1, CAST(min(year) FILTER (WHERE cum >= 10) - min(release_year) AS INTEGER) AS lag10, CAST(min(year) FILTER (WHERE cum >= 100) - min(release_year) AS INTEGER) AS lag100 FROM (SELECT model, release_year, year, sum(n) OVER (PARTITION BY model ORDER BY year) AS cum FROM (SELECT model, release_year, year, count(DISTINCT paper) AS n FROM enriched WHERE release_year IS NOT NULL GROUP BY 1, 2, 3)) GROUP BY model"))
def adoption_after_release(spark, d):
    yearly = observed(spark, d, ("year",), ("release_year",), ok=False).where("release_year is not null").groupBy("model", "release_year", "year").agg(F.count("*").alias("n"))
    cum = yearly.withColumn("cum", F.sum("n").over(Window.partitionBy("model").orderBy("year")))
    lag = lambda k: (F.min(F.when(F.col("cum") >= k, F.col("year"))) - F.min("release_year")).alias(f"lag{k}")
    return cum.groupBy("model").agg(F.min("release_year").alias("release_year"), *map(lag, (1, 10, 100)))


@query("year_agreement", "SELECT o_orderpriority, count(*) AS n, round(avg(CASE WHEN year(o_orderdate) = year(o_orderdate + INTERVAL 90 DAY) THEN 1 ELSE 0 END), 6) AS agreement FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1")
def year_agreement(spark, d):
    rows = table(spark, d, "orders").where("o_orderkey % 3 <> 0")
    return panels.share_by(rows, ["o_orderpriority"], F.year("o_orderdate") == F.year(F.date_add("o_orderdate", 90)), "agreement").withColumn("agreement", F.round("agreement", 6))


@query("nulls_last", twin("SELECT model, release_year, row_number() OVER (ORDER BY release_year DESC NULLS LAST, model) AS place FROM specs QUALIFY place <= 50"))
def nulls_last(spark, d):
    """A report of the fifty newest models; unknown years stand last."""
    top = specs(spark, d).orderBy(F.desc_nulls_last("release_year"), "model").limit(50).select("model", "release_year")
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last("release_year"), "model")).cast("bigint"))


# ---- embeddings, topics, evaluation ----------------------------------------------------------


@query("aligned_embeddings", "SELECT vec_id, len(embedding) AS n, coalesce(text, '') AS text FROM embeddings LEFT JOIN (SELECT doc_id AS vec_id, text FROM documents WHERE doc_id % 2 = 0) USING (vec_id)")
def aligned_embeddings(spark, d):
    v, docs = table(spark, d, "embeddings"), table(spark, d, "documents").where("doc_id % 2 = 0")
    chunks = v.union(v.where("vec_id % 10 = 0"))
    out = encode.aligned(chunks, docs.select(F.col("doc_id").alias("vec_id"), F.col("text").alias("abstract")), "vec_id")
    return out.select("vec_id", F.size("embedding").cast("bigint").alias("n"), "text")


@query("topic_overview", twin("SELECT field AS topic, papers, label FROM (SELECT field, count(DISTINCT paper) AS papers FROM enriched WHERE release_year IS NOT NULL GROUP BY field) LEFT JOIN (SELECT n_name AS field, lower(substr(n_name, 1, 3)) AS label FROM nation WHERE n_nationkey % 2 = 0) USING (field)"))
def topic_overview(spark, d):
    per = enriched(spark, d).where("release_year is not null").groupBy(F.col("field").alias("topic")).agg(F.countDistinct("paper").alias("papers"))
    words = table(spark, d, "nation").where("n_nationkey % 2 = 0").select(F.col("n_name").alias("topic"), F.lower(F.substring("n_name", 1, 3)).alias("label"))
    return per.join(F.broadcast(words), "topic", "left")


@query("gold_spans", "SELECT event_id, user_id AS s, user_id + 4 AS e FROM events WHERE event_id % 2 = 0")
def gold_spans(spark, d):
    e = table(spark, d, "events")
    label = F.array(F.array(F.col("user_id").cast("string"), (F.col("user_id") + 4).cast("string"), F.when(F.col("event_id") % 2 == 0, "Hardware-Device").otherwise("Software")))
    return e.select("event_id", F.inline(evaluation.gold_spans(label))).select("event_id", F.col("start").alias("s"), F.col("end").alias("e"))


# ---- streams ---------------------------------------------------------------------------------


@query("stream_ingest", "SELECT event_id, user_id, CAST(len(props) AS BIGINT) AS n FROM events WHERE user_id % 2 = 0")
def stream_ingest(spark, d):
    """New files of the event folder, taken twice: the second run finds nothing new."""
    base, source = _stream_folder(spark), f"{d}/event[s].parquet"  # a pattern: a stream takes no single file
    kind = spark.read.parquet(f"{d}/events.parquet").schema
    keep = lambda df: df.where("user_id % 2 = 0").select("event_id", "user_id", F.length("props").cast("bigint").alias("n"))
    for _ in range(2):
        ingest.ingest_new(spark, source, kind, f"{base}/rows", f"{base}/state", keep)
    return spark.read.parquet(f"{base}/rows")


@query("stream_hourly", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, user_id % 10 AS part, count(*) AS n FROM events GROUP BY 1, 2")
def stream_hourly(spark, d):
    base, kind = _stream_folder(spark), spark.read.parquet(f"{d}/events.parquet").schema
    events = spark.readStream.schema(kind).parquet(f"{d}/event[s].parquet")
    timed = events.select(F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 10).alias("part"))
    out = ingest.run_to_end(ingest.windowed_counts(timed, "ts", "part"), f"{base}/counts", f"{base}/state")
    return out.select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "part", "n")


def _stream_folder(spark) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
