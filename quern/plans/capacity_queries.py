"""Capacity and panel queries."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from quern.functions.stats import nearest_quantile
from quern.operators import capacity
from quern.plans.standins import dealt, enriched, mentions, nearest_sql, papers, query, specs, table, twin, used_mentions

CAPS = f"caps AS (SELECT year, least(greatest(q, 1), 65536) AS cap FROM ({nearest_sql('used', 'year', 'device_count', 0.999, 'q')}))"
WINSOR = CAPS + ", counted AS (SELECT u.*, CASE WHEN device_count IS NULL THEN 1.0::DOUBLE ELSE CAST(least(device_count, coalesce(cap, 65536), 65536) AS DOUBLE) END AS n_dev FROM used u LEFT JOIN caps USING (year))"
MODELS = WINSOR + """, models AS (
  SELECT c.paper, c.model, c.n_dev, c.mem AS memory_gb, s.*EXCLUDE (model), coalesce(c.mem, s.vram_gb) AS vram_eff
  FROM (SELECT paper, model, max(n_dev) AS n_dev, max(memory_gb) AS mem FROM counted GROUP BY paper, model) c LEFT JOIN specs s USING (model))"""
CAPACITY = MODELS + """, capacity AS (
  SELECT paper, sum(n_dev * fp32) AS reported_fp32, sum(n_dev * fp64) AS reported_fp64, sum(n_dev * tensor) AS reported_tensor,
         bool_and(fp32 IS NULL) AS spec_missing_fp32, bool_and(fp64 IS NULL) AS spec_missing_fp64, bool_and(tensor IS NULL) AS spec_missing_tensor, bool_and(vram_eff IS NULL) AS spec_missing_vram,
         sum(n_dev * vram_eff) AS reported_vram, sum(n_dev * tdp) AS reported_tdp, max(n_dev) AS max_devices, sum(n_dev) AS total_devices, count(DISTINCT model) AS n_models,
         max(release_year) AS newest_release, min(release_year) AS oldest_release, coalesce(bool_or(segment = 'STANDARD'), false) AS any_datacenter, coalesce(bool_or(segment = 'SMALL'), false) AS any_consumer, coalesce(bool_or(tensor IS NOT NULL), false) AS tensor_capable
  FROM models GROUP BY paper), cap_year AS (SELECT c.*, p.year, p.field FROM capacity c JOIN papers p USING (paper))"""


def _capacity(spark, d):
    models = capacity.per_model(capacity.winsorised(used_mentions(spark, d)), specs(spark, d))
    return capacity.paper_capacity(models, "STANDARD", "SMALL")


def _capacity_years(spark, d):
    return _capacity(spark, d).join(papers(spark, d).select("paper", "year", "field"), "paper")


@query("winsor_caps", twin("SELECT year, CAST(cap AS BIGINT) AS cap FROM caps", CAPS))
def winsor_caps(spark, d):
    return capacity.yearly_caps(used_mentions(spark, d)).select("year", F.col("cap").cast("bigint").alias("cap"))


@query("winsorised_counts_floor", twin("SELECT paper, mention, n_dev FROM counted", WINSOR))
def winsorised_floor(spark, d):
    return capacity.winsorised(used_mentions(spark, d)).select("paper", "mention", "n_dev")


_EXPLICIT = f"ex AS (SELECT * FROM used WHERE device_count_basis = 'explicit'), xcaps AS (SELECT year, least(greatest(q, 1), 65536) AS cap FROM ({nearest_sql('ex', 'year', 'device_count', 0.999, 'q')}))"


@query("winsorised_counts_explicit", twin("SELECT paper, mention, CASE WHEN device_count IS NOT NULL THEN CAST(least(device_count, coalesce(cap, 65536), 65536) AS DOUBLE) END AS n_dev FROM ex LEFT JOIN xcaps USING (year)", _EXPLICIT))
def winsorised_explicit(spark, d):
    return capacity.winsorised(used_mentions(spark, d), "explicit").select("paper", "mention", "n_dev")


@query("dedup_paper_model", twin("SELECT paper, model, n_dev, vram_eff, vendor FROM models", MODELS))
def dedup_paper_model(spark, d):
    return capacity.per_model(capacity.winsorised(used_mentions(spark, d)), specs(spark, d)).select("paper", "model", "n_dev", "vram_eff", "vendor")


@query("capacity_partial_sums", twin("SELECT paper, round(reported_fp32, 3) AS fp32, round(reported_fp64, 3) AS fp64, round(reported_tensor, 3) AS tensor, reported_vram AS vram, reported_tdp AS tdp, max_devices, total_devices, n_models, newest_release, oldest_release, any_datacenter, any_consumer, tensor_capable FROM capacity", CAPACITY))
def capacity_partial_sums(spark, d):
    c = _capacity(spark, d)
    return c.select("paper", *[F.round(f"reported_{a}", 3).alias(a) for a in ("fp32", "fp64", "tensor")], F.col("reported_vram").alias("vram"), F.col("reported_tdp").alias("tdp"), "max_devices", "total_devices", "n_models", "newest_release", "oldest_release", "any_datacenter", "any_consumer", "tensor_capable")


@query("spec_missing_flags", twin("SELECT paper, spec_missing_fp32, spec_missing_fp64, spec_missing_tensor, spec_missing_vram FROM capacity", CAPACITY))
def spec_missing_flags(spark, d):
    return _capacity(spark, d).select("paper", "spec_missing_fp32", "spec_missing_fp64", "spec_missing_tensor", "spec_missing_vram")


@query("spec_coverage_by_year", twin("SELECT year, round(avg(CASE WHEN spec_missing_fp32 THEN 0 ELSE 1 END), 6) AS fp32, round(avg(CASE WHEN spec_missing_fp64 THEN 0 ELSE 1 END), 6) AS fp64, round(avg(CASE WHEN spec_missing_tensor THEN 0 ELSE 1 END), 6) AS tensor FROM cap_year GROUP BY year", CAPACITY))
def spec_coverage_by_year(spark, d):
    share = lambda a: F.round(F.avg((~F.col(f"spec_missing_{a}")).cast("int")), 6).alias(a)
    return _capacity_years(spark, d).groupBy("year").agg(*map(share, capacity.AXES))


@query("capacity_median_p90", twin(f"SELECT year, round(m, 3) AS median_fp32, round(p90, 3) AS p90_fp32, round(s, 2) AS sum_fp32 FROM (SELECT year, median(reported_fp32) AS m, sum(reported_fp32) AS s FROM cap_year GROUP BY year) JOIN ({nearest_sql('cap_year', 'year', 'reported_fp32', 0.9, 'p90')}) USING (year)", CAPACITY))
def capacity_median_p90(spark, d):
    c = _capacity_years(spark, d)
    plain = c.groupBy("year").agg(F.round(F.median("reported_fp32"), 3).alias("median_fp32"), F.round(F.sum("reported_fp32"), 2).alias("sum_fp32"))
    return plain.join(nearest_quantile(c, ["year"], "reported_fp32", 0.9, "q"), "year").select("year", "median_fp32", F.round("q", 3).alias("p90_fp32"), "sum_fp32")


@query("per_device_capacity", twin("SELECT paper, round(reported_fp32 / nullif(total_devices, 0), 6) AS per_device FROM capacity", CAPACITY))
def per_device_capacity(spark, d):
    return _capacity(spark, d).select("paper", F.round(F.try_divide("reported_fp32", "total_devices"), 6).alias("per_device"))


@query("scale_out_shares", twin(f"SELECT year, round(avg(CASE WHEN max_devices <= 1 THEN 1 ELSE 0 END), 6) AS le1, round(avg(CASE WHEN max_devices >= 2 THEN 1 ELSE 0 END), 6) AS ge2, round(avg(CASE WHEN max_devices >= 8 THEN 1 ELSE 0 END), 6) AS ge8, round(avg(CASE WHEN max_devices >= 64 THEN 1 ELSE 0 END), 6) AS ge64, round(avg(CASE WHEN max_devices >= 512 THEN 1 ELSE 0 END), 6) AS ge512, max(p90) AS p90 FROM cap_year JOIN ({nearest_sql('cap_year', 'year', 'max_devices', 0.9, 'p90')}) USING (year) GROUP BY year", CAPACITY))
def scale_out_shares(spark, d):
    c = _capacity_years(spark, d)
    share = lambda cond, n: F.round(F.avg(F.when(cond, 1).otherwise(0)), 6).alias(n)
    m = F.col("max_devices")
    out = c.groupBy("year").agg(share(m <= 1, "le1"), *[share(m >= k, f"ge{k}") for k in (2, 8, 64, 512)])
    return out.join(nearest_quantile(c, ["year"], "max_devices", 0.9, "p90"), "year")


@query("tensor_share_by_year", twin("SELECT year, round(avg(CASE WHEN tensor_capable THEN 1 ELSE 0 END), 6) AS share FROM cap_year GROUP BY year", CAPACITY))
def tensor_share_by_year(spark, d):
    return _capacity_years(spark, d).groupBy("year").agg(F.round(F.avg(F.col("tensor_capable").cast("int")), 6).alias("share"))


@query("capacity_by_top_field", twin("SELECT year, coalesce(t.field, 'Other') AS segment, count(*) AS n, round(median(reported_fp32), 3) AS median_fp32 FROM cap_year c LEFT JOIN (SELECT field FROM papers GROUP BY field ORDER BY count(*) DESC, field LIMIT 5) t USING (field) GROUP BY 1, 2 HAVING count(*) >= 10", CAPACITY))
def capacity_by_top_field(spark, d):
    top = papers(spark, d).groupBy("field").count().orderBy(F.desc("count"), "field").limit(5).select("field", F.lit(True).alias("top"))
    c = _capacity_years(spark, d).join(top, "field", "left").withColumn("segment", F.when(F.col("top"), F.col("field")).otherwise("Other"))
    return c.groupBy("year", "segment").agg(F.count("*").alias("n"), F.round(F.median("reported_fp32"), 3).alias("median_fp32")).where("n >= 10")


@query("precision_by_year", twin("SELECT year, round(avg(CASE WHEN price > 150000 THEN 1 ELSE 0 END), 6) AS high, round(avg(CASE WHEN tensor_capable THEN 1 ELSE 0 END), 6) AS tensor FROM cap_year JOIN (SELECT paper, price FROM papers) USING (paper) GROUP BY year", CAPACITY))
def precision_by_year(spark, d):
    c = _capacity_years(spark, d).join(papers(spark, d).select("paper", "price"), "paper")
    return c.groupBy("year").agg(F.round(F.avg((F.col("price") > 150000).cast("int")), 6).alias("high"), F.round(F.avg(F.col("tensor_capable").cast("int")), 6).alias("tensor"))


@query("capacity_policy_comparison", twin("SELECT year, round(max(CASE WHEN k = 'floor' THEN v END), 3) AS floor_median, round(max(CASE WHEN k = 'explicit' THEN v END), 3) AS explicit_median FROM (SELECT year, 'floor' AS k, median(n_dev) AS v FROM counted GROUP BY year UNION ALL SELECT year, 'explicit', median(CASE WHEN device_count IS NOT NULL THEN CAST(least(device_count, coalesce(cap, 65536), 65536) AS DOUBLE) END) FROM ex LEFT JOIN xcaps USING (year) GROUP BY year) GROUP BY year", WINSOR + ", " + _EXPLICIT))
def capacity_policy_comparison(spark, d):
    u = used_mentions(spark, d)
    first = capacity.winsorised(u).groupBy("year").agg(F.round(F.median("n_dev"), 3).alias("floor_median"))
    second = capacity.winsorised(u, "explicit").groupBy("year").agg(F.round(F.median("n_dev"), 3).alias("explicit_median"))
    return first.join(second, "year")


_FLAGS = "flags AS (SELECT paper, true AS accel_any, coalesce(bool_or(usage_context = 'used-in-this-work'), false) AS accel_used, coalesce(bool_or(release_year IS NOT NULL), false) AS model_specific, coalesce(bool_or(usage_context = 'used-in-this-work' AND release_year IS NOT NULL), false) AS model_specific_used, count(*) AS n_mentions, count(DISTINCT model) FILTER (WHERE release_year IS NOT NULL) AS n_models, array_to_string(list_sort(list(DISTINCT vendor) FILTER (WHERE vendor IS NOT NULL)), ',') AS vendors, array_to_string(list_sort(list(DISTINCT usage_context)), ',') AS contexts, max(release_year) FILTER (WHERE usage_context = 'used-in-this-work') AS newest_used, min(release_year) FILTER (WHERE usage_context = 'used-in-this-work') AS oldest_used, max(device_count) FILTER (WHERE usage_context = 'used-in-this-work') AS max_device_count FROM enriched WHERE status = 'ok' GROUP BY paper)"


def _flags(spark, d):
    # Specifications first: mentions then meet at their paper once, to be joined and to be counted.
    lines = table(spark, d, "lineitem")
    said = mentions(spark, d).where("status = 'ok'").select("paper", "model", "usage_context", "status", "device_count")
    named = dealt(said, "model", lines).join(dealt(specs(spark, d).select("model", "release_year", "vendor"), "model", lines), "model", "left")
    return capacity.paper_flags(dealt(named, "paper", lines).join(dealt(papers(spark, d).select("paper"), "paper", lines), "paper"))


@query("paper_flags", twin("SELECT *, NOT model_specific AS generic_only FROM flags", _FLAGS))
def paper_flags(spark, d):
    return _flags(spark, d).withColumns({c: F.array_join(c, ",") for c in ("vendors", "contexts")})


def _population(spark, d):
    """Every paper with its flags, false where it mentions nothing."""
    flags = _flags(spark, d).where("paper % 3 <> 0")
    return papers(spark, d).join(flags, "paper", "left").na.fill(False, ["accel_any", "accel_used", "model_specific", "model_specific_used"])


_POP = _FLAGS + ", pop AS (SELECT p.*, coalesce(accel_any, false) AS accel_any, coalesce(accel_used, false) AS accel_used, coalesce(model_specific, false) AS model_specific, coalesce(model_specific_used, false) AS model_specific_used FROM papers p LEFT JOIN (SELECT * FROM flags WHERE paper % 3 <> 0) USING (paper))"


@query("population_join", twin("SELECT paper, year, field, accel_any, accel_used, model_specific FROM pop WHERE year BETWEEN 1995 AND 1999", _POP))
def population_join(spark, d):
    return _population(spark, d).where(F.col("year").between(1995, 1999)).select("paper", "year", "field", "accel_any", "accel_used", "model_specific")


@query("prevalence_by_year", twin("SELECT year, count(*) AS n, round(avg(CASE WHEN accel_any THEN 1 ELSE 0 END), 6) AS any_share, round(avg(CASE WHEN accel_used THEN 1 ELSE 0 END), 6) AS used_share FROM pop GROUP BY year HAVING count(*) >= 100", _POP))
def prevalence_by_year(spark, d):
    share = lambda c, n: F.round(F.avg(F.col(c).cast("int")), 6).alias(n)
    return _population(spark, d).groupBy("year").agg(F.count("*").alias("n"), share("accel_any", "any_share"), share("accel_used", "used_share")).where("n >= 100")


_TOPF = "top AS (SELECT field FROM pop WHERE accel_any GROUP BY field ORDER BY count(*) DESC, field LIMIT 6)"


@query("prevalence_by_field_other", twin("SELECT year, CASE WHEN pop.field IS NULL THEN 'No label' WHEN t.field IS NULL THEN 'Other' ELSE t.field END AS segment, count(*) AS n, round(avg(CASE WHEN accel_used THEN 1 ELSE 0 END), 6) AS share FROM pop LEFT JOIN top t ON t.field = pop.field GROUP BY 1, 2", _POP + ", " + _TOPF))
def prevalence_by_field_other(spark, d):
    p = _population(spark, d)
    top = p.where("accel_any").groupBy("field").count().orderBy(F.desc("count"), "field").limit(6).select("field", F.lit(True).alias("top"))
    segment = F.when(F.col("field").isNull(), "No label").when(F.col("top"), F.col("field")).otherwise("Other")
    return p.join(top, "field", "left").groupBy("year", segment.alias("segment")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("accel_used").cast("int")), 6).alias("share"))


@query("field_composition", twin("SELECT year, field, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY year), 6) AS share FROM papers GROUP BY year, field"))
def field_composition(spark, d):
    n = papers(spark, d).groupBy("year", "field").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("year")), 6))


@query("top_fields", twin("SELECT field, count(*) AS n FROM pop WHERE accel_any GROUP BY field ORDER BY n DESC, field LIMIT 10", _POP))
def top_fields(spark, d):
    return _population(spark, d).where("accel_any").groupBy("field").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "field").limit(10)


@query("funnel", twin("SELECT step, n, round(100.0 * n / max(n) FILTER (WHERE step = 'all') OVER (), 4) AS pct FROM (SELECT 'all' AS step, count(*) AS n FROM pop UNION ALL SELECT 'any', count(*) FROM pop WHERE accel_any UNION ALL SELECT 'used', count(*) FROM pop WHERE accel_used UNION ALL SELECT 'specific', count(*) FROM pop WHERE model_specific UNION ALL SELECT 'specific_used', count(*) FROM pop WHERE model_specific_used)", _POP))
def funnel(spark, d):
    one = _population(spark, d).agg(F.count("*").alias("all"), *[F.count_if(c).alias(n) for c, n in (("accel_any", "any"), ("accel_used", "used"), ("model_specific", "specific"), ("model_specific_used", "specific_used"))])
    long = one.selectExpr("`all` as total", "stack(5, 'all', `all`, 'any', `any`, 'used', used, 'specific', specific, 'specific_used', specific_used) as (step, n)")
    return long.select("step", "n", F.round(100.0 * F.col("n") / F.col("total"), 4).alias("pct"))


@query("context_mix", twin("SELECT year, ctx, n, round(n / total, 6) AS share FROM (SELECT year, usage_context AS ctx, count(DISTINCT paper) AS n FROM enriched WHERE status = 'ok' GROUP BY 1, 2) JOIN (SELECT year, count(DISTINCT paper) AS total FROM enriched WHERE status = 'ok' GROUP BY 1) USING (year)"))
def context_mix(spark, d):
    f = _flags(spark, d).join(papers(spark, d).select("paper", "year"), "paper")
    per = f.select("year", "paper", F.explode("contexts").alias("ctx")).groupBy("year", "ctx").agg(F.countDistinct("paper").alias("n"))
    total = f.groupBy("year").agg(F.countDistinct("paper").alias("total"))
    return per.join(total, "year").select("year", "ctx", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


@query("specificity", twin("SELECT year, count(*) AS n, round(avg(CASE WHEN model_specific THEN 1 ELSE 0 END), 6) AS specific FROM pop WHERE accel_any GROUP BY year", _POP))
def specificity(spark, d):
    return _population(spark, d).where("accel_any").groupBy("year").agg(F.count("*").alias("n"), F.round(F.avg(F.col("model_specific").cast("int")), 6).alias("specific"))


@query("rescue_share", twin("SELECT year, count(*) AS n, count(*) FILTER (WHERE device_count_basis = 'inferred') AS gated_only, count(*) FILTER (WHERE device_count_basis = 'inferred' AND device_count IS NULL) AS rescued, round(count(*) FILTER (WHERE device_count_basis = 'inferred' AND device_count IS NULL) / count(*), 6) AS rescued_share FROM enriched GROUP BY year"))
def rescue_share(spark, d):
    gated, rescued = F.col("device_count_basis") == "inferred", (F.col("device_count_basis") == "inferred") & F.col("device_count").isNull()
    return enriched(spark, d).groupBy("year").agg(F.count("*").alias("n"), F.count_if(gated).alias("gated_only"), F.count_if(rescued).alias("rescued"), F.round(F.count_if(rescued) / F.count("*"), 6).alias("rescued_share"))


@query("composition_pivot", twin("SELECT year, count(*) FILTER (WHERE region_no = 0) AS r0, count(*) FILTER (WHERE region_no = 1) AS r1, count(*) FILTER (WHERE region_no = 2) AS r2, count(*) FILTER (WHERE region_no = 3) AS r3, count(*) FILTER (WHERE region_no = 4) AS r4 FROM papers GROUP BY year"))
def composition_pivot(spark, d):
    return papers(spark, d).groupBy("year").pivot("region_no", [0, 1, 2, 3, 4]).count().na.fill(0).withColumnsRenamed({str(k): f"r{k}" for k in range(5)})


@query("vendor_share", twin("SELECT year, vendor, n, round(n / sum(n) OVER (PARTITION BY year), 6) AS share FROM (SELECT year, vendor, count(DISTINCT paper) AS n FROM enriched WHERE usage_context = 'used-in-this-work' GROUP BY 1, 2)"))
def vendor_share(spark, d):
    n = enriched(spark, d).where("usage_context = 'used-in-this-work'").groupBy("year", "vendor").agg(F.countDistinct("paper").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("year")), 6))


@query("vendor_resolution", twin("SELECT vendor, count(*) AS n FROM (SELECT coalesce(CASE WHEN model % 4 <> 0 THEN s.vendor END, 'label-' || device_count_basis) AS vendor FROM mentions LEFT JOIN specs s USING (model)) GROUP BY vendor"))
def vendor_resolution(spark, d):
    joined = mentions(spark, d).join(specs(spark, d).select("model", "vendor"), "model", "left")
    return joined.select(F.coalesce(F.when(F.col("model") % 4 != 0, F.col("vendor")), F.concat(F.lit("label-"), "device_count_basis")).alias("vendor")).groupBy("vendor").agg(F.count("*").alias("n"))


@query("multi_vendor", twin("SELECT year, count(*) AS n, round(avg(CASE WHEN v > 1 THEN 1 ELSE 0 END), 6) AS multi FROM (SELECT year, paper, count(DISTINCT vendor) AS v FROM enriched WHERE usage_context = 'used-in-this-work' GROUP BY 1, 2) GROUP BY year"))
def multi_vendor(spark, d):
    per = enriched(spark, d).where("usage_context = 'used-in-this-work'").groupBy("year", "paper").agg(F.countDistinct("vendor").alias("v"))
    return per.groupBy("year").agg(F.count("*").alias("n"), F.round(F.avg((F.col("v") > 1).cast("int")), 6).alias("multi"))


@query("two_vendor_by_year", twin("SELECT year, count(DISTINCT paper) FILTER (WHERE vendor = 'Brand#11') AS v11, count(DISTINCT paper) FILTER (WHERE vendor = 'Brand#22') AS v22 FROM enriched WHERE vendor IN ('Brand#11', 'Brand#22') GROUP BY year"))
def two_vendor_by_year(spark, d):
    e = enriched(spark, d).where(F.col("vendor").isin("Brand#11", "Brand#22"))
    return e.groupBy("year").pivot("vendor", ["Brand#11", "Brand#22"]).agg(F.countDistinct("paper")).na.fill(0).withColumnsRenamed({"Brand#11": "v11", "Brand#22": "v22"})


@query("event_parts_pivot", twin("SELECT year, count(DISTINCT paper) FILTER (WHERE model = 10) AS m10, count(DISTINCT paper) FILTER (WHERE model = 20) AS m20, count(DISTINCT paper) FILTER (WHERE model = 30) AS m30 FROM enriched WHERE model IN (10, 20, 30) GROUP BY year"))
def event_parts_pivot(spark, d):
    e = enriched(spark, d).where(F.col("model").isin(10, 20, 30))
    return e.groupBy("year").pivot("model", [10, 20, 30]).agg(F.countDistinct("paper")).na.fill(0).withColumnsRenamed({str(k): f"m{k}" for k in (10, 20, 30)})


@query("model_field_matrix", twin("SELECT segment, count(*) FILTER (WHERE field LIKE '%A%') AS n_a, count(*) FILTER (WHERE field NOT LIKE '%A%') AS n_b FROM enriched GROUP BY segment"))
def model_field_matrix(spark, d):
    e = enriched(spark, d).withColumn("has", F.when(F.col("field").contains("A"), "n_a").otherwise("n_b"))
    return e.groupBy("segment").pivot("has", ["n_a", "n_b"]).count().na.fill(0)


@query("top_models_by_year", twin("SELECT year, model, count(DISTINCT paper) AS n FROM enriched JOIN (SELECT model FROM enriched GROUP BY model ORDER BY count(DISTINCT paper) DESC, model LIMIT 20) USING (model) GROUP BY 1, 2"))
def top_models_by_year(spark, d):
    e = enriched(spark, d)
    top = e.groupBy("model").agg(F.countDistinct("paper").alias("n")).orderBy(F.desc("n"), "model").limit(20)
    return e.join(top, "model", "left_semi").groupBy("year", "model").agg(F.countDistinct("paper").alias("n"))


@query("ingest_audit", twin("SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END), 6) AS skip_rate, round(avg(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END), 6) AS pdf_rate, round(median(o_totalprice), 3) AS median_chars FROM orders GROUP BY 1"))
def ingest_audit(spark, d):
    o = table(spark, d, "orders")
    rate = lambda c, n: F.round(F.avg(c.cast("int")), 6).alias(n)
    return o.groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"), rate(F.col("o_orderstatus") == "F", "skip_rate"), rate(F.col("o_orderpriority") == "1-URGENT", "pdf_rate"), F.round(F.median("o_totalprice"), 3).alias("median_chars"))


_CITE = "cites AS (SELECT p.paper, p.year, p.year <= 1998 AS window_complete, c.cites IS NOT NULL AS has_outcomes, c.cites FROM (SELECT * FROM papers WHERE paper IN (SELECT paper FROM mentions WHERE status = 'ok')) p LEFT JOIN (SELECT o_orderkey AS paper, CAST(floor(o_totalprice) AS BIGINT) % 100 AS cites FROM orders WHERE o_orderkey % 4 <> 0) c USING (paper))"


def _citations(spark, d):
    outcomes = table(spark, d, "orders").where("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("paper"), (F.floor("o_totalprice") % 100).alias("cites"))
    focal = papers(spark, d).join(mentions(spark, d).where("status = 'ok'").select("paper"), "paper", "left_semi")
    return focal.join(outcomes, "paper", "left").select("paper", "year", (F.col("year") <= 1998).alias("window_complete"), F.col("cites").isNotNull().alias("has_outcomes"), "cites")


@query("citation_windows", twin("SELECT * FROM cites", _CITE))
def citation_windows(spark, d):
    return _citations(spark, d)


@query("citation_support", twin("SELECT model, count(*) AS n, CAST(sum(cites) AS BIGINT) AS total, round(avg(cites), 6) AS mean, median(cites) AS med FROM (SELECT DISTINCT model, paper FROM mentions) JOIN cites USING (paper) WHERE window_complete AND has_outcomes GROUP BY model HAVING count(*) >= 10", _CITE))
def citation_support(spark, d):
    pairs = mentions(spark, d).select("model", "paper").distinct()
    c = pairs.join(_citations(spark, d), "paper").where("window_complete and has_outcomes")
    return c.groupBy("model").agg(F.count("*").alias("n"), F.sum("cites").alias("total"), F.round(F.avg("cites"), 6).alias("mean"), F.median("cites").alias("med")).where("n >= 10")
