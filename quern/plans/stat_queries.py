"""Statistics over papers, mentions and specifications."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from quern.functions import stats
from quern.plans.standins import enriched, observed, observed_in_papers, papers, query, specs, twin

_POS = "pos AS (SELECT year, field, region_no, CAST(floor(price) AS BIGINT) AS x FROM papers)"


def _prices(spark, d):
    return papers(spark, d).select("year", "field", "region_no", F.floor("price").alias("x"))


@query("nearest_quantile_by_year", twin("SELECT year, x AS q FROM (SELECT year, x, row_number() OVER (PARTITION BY year ORDER BY x) - 1 AS k, count(*) OVER (PARTITION BY year) AS n FROM pos) WHERE k = CAST(floor((n - 1) * 0.9 + 0.5) AS BIGINT)", _POS))
def nearest_quantile_by_year(spark, d):
    return stats.nearest_quantile(_prices(spark, d), ["year"], "x", 0.9, "q")


@query("gini_by_year", twin("SELECT year, count(*) AS n, round(sum((2 * i - n - 1) * x)::DOUBLE / (max(n) * sum(x)), 8) AS gini FROM (SELECT year, x, row_number() OVER (PARTITION BY year ORDER BY x) AS i, count(*) OVER (PARTITION BY year) AS n FROM pos) GROUP BY year", _POS))
def gini_by_year(spark, d):
    return stats.gini(_prices(spark, d), ["year"], "x").withColumn("gini", F.round("gini", 8))


@query("top_share", twin("SELECT year, max(n) AS n, round(sum(x) FILTER (WHERE i <= greatest(1, round_even(n * 0.01, 0)))::DOUBLE / sum(x), 8) AS top_share FROM (SELECT year, x, row_number() OVER (PARTITION BY year ORDER BY x DESC) AS i, count(*) OVER (PARTITION BY year) AS n FROM pos) GROUP BY year", _POS))
def top_share(spark, d):
    return stats.top_share(_prices(spark, d), ["year"], "x", 0.01).withColumn("top_share", F.round("top_share", 8))


@query("top1_top10_share", twin("SELECT year, CAST(sum(x) AS BIGINT) AS total, round(sum(x) FILTER (WHERE i = 1)::DOUBLE / sum(x), 8) AS top1, round(sum(x) FILTER (WHERE i <= 10)::DOUBLE / sum(x), 8) AS top10 FROM (SELECT year, x, row_number() OVER (PARTITION BY year ORDER BY x DESC) AS i FROM pos) GROUP BY year", _POS))
def top1_top10_share(spark, d):
    x = _prices(spark, d)
    counted = x.groupBy("year", "x").agg(F.count("*").alias("c"))
    above = Window.partitionBy("year").orderBy(F.desc("x")).rowsBetween(Window.unboundedPreceding, -1)
    ranked = counted.withColumn("before", F.coalesce(F.sum("c").over(above), F.lit(0)))
    part = lambda k: F.sum(F.col("x") * F.greatest(F.lit(0), F.least(F.col("c"), k - F.col("before"))))
    total = F.sum(F.col("x") * F.col("c"))
    return ranked.groupBy("year").agg(total.alias("total"), F.round(part(1) / total, 8).alias("top1"), F.round(part(10) / total, 8).alias("top10"))


@query("lorenz_points", twin("SELECT region_no, round(p, 8) AS p, round(share, 8) AS share FROM (SELECT region_no, sum(c) OVER w / sum(c) OVER (PARTITION BY region_no) AS p, sum(c * x) OVER w::DOUBLE / sum(c * x) OVER (PARTITION BY region_no) AS share FROM (SELECT region_no, x // 1000 + 1 AS x, count(*) AS c FROM pos GROUP BY 1, 2) WINDOW w AS (PARTITION BY region_no ORDER BY x)) UNION ALL SELECT DISTINCT region_no, 0.0::DOUBLE, 0.0::DOUBLE FROM pos", _POS))
def lorenz_points(spark, d):
    x = _prices(spark, d).withColumn("x", F.floor(F.col("x") / 1000) + 1)
    return stats.lorenz(x, ["region_no"], "x", 100).select("region_no", F.round("p", 8).alias("p"), F.round("share", 8).alias("share"))


@query("theil_decomposition", twin("SELECT year, n, round(total, 7) AS total, round(between_part, 7) AS between_part, round(total - between_part, 7) AS within_part FROM (SELECT year, max(n) AS n, sum(x / s * ln(x / mu)) AS total FROM (SELECT *, count(*) OVER w AS n, sum(x) OVER w AS s, avg(x) OVER w AS mu FROM pos WINDOW w AS (PARTITION BY year)) GROUP BY year HAVING max(n) >= 200) JOIN (SELECT year, sum(sg / s * ln((sg / ng) / mu)) AS between_part FROM (SELECT year, field, sum(x) AS sg, count(*) AS ng FROM pos GROUP BY 1, 2) JOIN (SELECT year, sum(x) AS s, avg(x) AS mu FROM pos GROUP BY 1) USING (year) GROUP BY year) USING (year)", _POS))
def theil_decomposition(spark, d):
    t = stats.theil(_prices(spark, d).withColumn("x", F.col("x").cast("double")), ["year"], "field", "x", 200)
    return t.select("year", "n", F.round("total", 7).alias("total"), F.round("between", 7).alias("between_part"), F.round("within", 7).alias("within_part"))


_VN = "vn AS (SELECT year, vendor, count(DISTINCT paper) AS k FROM enriched GROUP BY 1, 2)"


@query("hhi_entropy", twin("SELECT year, count(*) AS vendors, round(sum(s * s), 8) AS hhi, round(CASE WHEN count(*) > 1 THEN -sum(s * ln(s)) / ln(count(*)) ELSE 0 END, 8) AS entropy FROM (SELECT year, k / sum(k) OVER (PARTITION BY year) AS s FROM vn) GROUP BY year", _VN))
def hhi_entropy(spark, d):
    n = observed_in_papers(spark, d, ("year",), ("vendor",), ok=False).groupBy("year", "vendor").agg(F.count("*").alias("k"))
    return stats.concentration(n, ["year"], "vendor", "k").select("year", "vendors", F.round("hhi", 8).alias("hhi"), F.round("entropy", 8).alias("entropy"))


_SPREAD = "vals AS (SELECT year, segment AS seg, device_count AS v FROM enriched WHERE device_count IS NOT NULL UNION ALL SELECT year, 'pooled', device_count FROM enriched WHERE device_count IS NOT NULL), spread AS (SELECT year, seg, max(q)::DOUBLE / max(med) AS ratio FROM (SELECT year, seg, median(v) OVER w AS med, count(*) OVER w AS n, CASE WHEN row_number() OVER (PARTITION BY year, seg ORDER BY v) - 1 = CAST(floor((count(*) OVER w - 1) * 0.9 + 0.5) AS BIGINT) THEN v END AS q FROM vals WINDOW w AS (PARTITION BY year, seg)) GROUP BY year, seg HAVING max(n) >= 10 AND max(med) > 0)"


@query("spread_ratio_ma", twin("SELECT year, seg, round(ratio, 6) AS ratio, round(avg(ratio) OVER (PARTITION BY seg ORDER BY year ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS smooth FROM spread", _SPREAD))
def spread_ratio_ma(spark, d):
    e = enriched(spark, d).where("device_count is not null")
    vals = e.select("year", F.col("segment").alias("seg"), F.col("device_count").alias("v")).unionByName(e.select("year", F.lit("pooled").alias("seg"), F.col("device_count").alias("v")))
    mid = vals.groupBy("year", "seg").agg(F.median("v").alias("med"), F.count("*").alias("n")).where("n >= 10 and med > 0")
    ratio = mid.join(stats.nearest_quantile(vals, ["year", "seg"], "v", 0.9, "q"), ["year", "seg"]).withColumn("ratio", F.col("q") / F.col("med"))
    near = Window.partitionBy("seg").orderBy("year").rowsBetween(-1, 1)
    return ratio.select("year", "seg", F.round("ratio", 6).alias("ratio"), F.round(F.avg("ratio").over(near), 6).alias("smooth"))


_OBS = "obs AS (SELECT DISTINCT e.paper, e.model, e.year, e.release_year, e.vendor, e.field FROM enriched e WHERE e.status = 'ok')"


def _observations(spark, d):
    """Different pairs of paper and model, with year, field and release."""
    return observed(spark, d, ("year", "field"), ("release_year", "vendor"))


@query("observation_table", twin("SELECT paper, model, year, release_year, count(*) OVER (PARTITION BY paper) AS n_models FROM obs", _OBS))
def observation_table(spark, d):
    o = observed_in_papers(spark, d, ("year", "field"), ("model", "release_year", "vendor"))
    return o.select("paper", "model", "year", "release_year", F.count("*").over(Window.partitionBy("paper")).alias("n_models"))


@query("support_rate", twin("SELECT model, count(*) AS papers, release_year, CASE WHEN release_year IS NOT NULL THEN 2001 - greatest(release_year, 1995) + 1 END AS exposure, round(count(*) / CASE WHEN release_year IS NOT NULL THEN 2001 - greatest(release_year, 1995) + 1 END, 6) AS rate FROM obs GROUP BY model, release_year", _OBS))
def support_rate(spark, d):
    exposure = F.when(F.col("release_year").isNotNull(), 2001 - F.greatest("release_year", F.lit(1995)) + 1)
    return _observations(spark, d).groupBy("model", "release_year").agg(F.count("*").alias("papers")).withColumn("exposure", exposure).withColumn("rate", F.round(F.col("papers") / F.col("exposure"), 6))


@query("support_since_release", twin("SELECT model, CAST(year - release_year AS INTEGER) AS age, count(*) AS n FROM obs JOIN (SELECT model FROM obs WHERE release_year IS NOT NULL GROUP BY model ORDER BY count(*) DESC, model LIMIT 12) USING (model) WHERE year >= release_year GROUP BY 1, 2", _OBS))
def support_since_release(spark, d):
    o = _observations(spark, d).where("release_year is not null")
    top = o.groupBy("model").count().orderBy(F.desc("count"), "model").limit(12)
    return o.join(top, "model", "left_semi").where("year >= release_year").groupBy("model", (F.col("year") - F.col("release_year")).alias("age")).agg(F.count("*").alias("n"))


_SHARE = "yearly AS (SELECT vendor, year, count(*) AS n FROM obs GROUP BY 1, 2), totals AS (SELECT year, count(*) AS t FROM papers GROUP BY 1)"


@query("share_smoothed", twin("SELECT vendor, year, n, round(n / t, 8) AS share, round((coalesce(lag(n / t) OVER w, 0) + n / t + coalesce(lead(n / t) OVER w, 0)) / 3, 8) AS smooth FROM yearly JOIN totals USING (year) WINDOW w AS (PARTITION BY vendor ORDER BY year)", _OBS + ", " + _SHARE))
def share_smoothed(spark, d):
    yearly = _observations(spark, d).groupBy("vendor", "year").agg(F.count("*").alias("n"))
    totals = papers(spark, d).groupBy("year").agg(F.count("*").alias("t"))
    s = yearly.join(totals, "year").withColumn("s", F.col("n") / F.col("t"))
    return s.select("vendor", "year", "n", F.round("s", 8).alias("share"), F.round(stats.three_tap(F.col("s"), ["vendor"], "year") / 3, 8).alias("smooth"))


_HALF = "sm AS (SELECT model, year, coalesce(lag(n) OVER w, 0) + n + coalesce(lead(n) OVER w, 0) AS sm, count(*) OVER (PARTITION BY model) AS rows FROM (SELECT model, year, count(*) AS n FROM obs GROUP BY 1, 2) WINDOW w AS (PARTITION BY model ORDER BY year)), pk AS (SELECT *, lead(sm) OVER (PARTITION BY model ORDER BY year) AS nx, max(sm) OVER (PARTITION BY model) AS top, first_value(year) OVER (PARTITION BY model ORDER BY sm DESC, year) AS peak FROM sm WHERE rows >= 4)"


@query("half_life", twin("SELECT model, max(peak) AS peak, min(year) FILTER (WHERE year > peak AND 2 * sm <= top AND 2 * nx <= top) AS half, min(year) FILTER (WHERE year > peak AND 2 * sm <= top AND 2 * nx <= top) - max(peak) AS years FROM pk GROUP BY model", _OBS + ", " + _HALF))
def half_life(spark, d):
    yearly = _observations(spark, d).groupBy("model", "year").agg(F.count("*").alias("n"))
    return stats.half_life(yearly, "model", "year", "n")


@query("adoption_lag", twin("SELECT vendor, CAST(min(year) FILTER (WHERE cum >= 1) - 1990 AS INTEGER) AS lag1, CAST(min(year) FILTER (WHERE cum >= 100) - 1990 AS INTEGER) AS lag100, CAST(min(year) FILTER (WHERE cum >= 500) - 1990 AS INTEGER) AS lag500 FROM (SELECT vendor, year, sum(n) OVER (PARTITION BY vendor ORDER BY year) AS cum FROM yearly) GROUP BY vendor", _OBS + ", " + _SHARE))
def adoption_lag(spark, d):
    yearly = _observations(spark, d).groupBy("vendor", "year").agg(F.count("*").alias("n"))
    cum = yearly.withColumn("cum", F.sum("n").over(Window.partitionBy("vendor").orderBy("year").rowsBetween(Window.unboundedPreceding, 0)))
    return cum.groupBy("vendor").agg(*[(F.min(F.when(F.col("cum") >= k, F.col("year"))) - 1990).alias(f"lag{k}") for k in (1, 100, 500)])


@query("linear_trend", twin("SELECT vendor, round(regr_slope(n, year), 6) AS slope, round(regr_intercept(n, year), 3) AS intercept FROM yearly GROUP BY vendor HAVING count(*) > 3", _OBS + ", " + _SHARE))
def linear_trend(spark, d):
    yearly = _observations(spark, d).groupBy("vendor", "year").agg(F.count("*").alias("n"))
    return yearly.groupBy("vendor").agg(F.round(F.regr_slope("n", "year"), 6).alias("slope"), F.round(F.regr_intercept("n", "year"), 3).alias("intercept"), F.count("*").alias("k")).where("k > 3").drop("k")


@query("pre_release_audit", twin("SELECT gap, count(*) AS n, round(avg(CASE WHEN gap < 0 THEN 1 ELSE 0 END), 6) AS pre FROM (SELECT CAST(year - release_year AS INTEGER) AS gap FROM obs WHERE release_year IS NOT NULL) GROUP BY gap", _OBS))
def pre_release_audit(spark, d):
    gap = _observations(spark, d).where("release_year is not null").select((F.col("year") - F.col("release_year")).alias("gap"))
    return gap.groupBy("gap").agg(F.count("*").alias("n"), F.round(F.avg((F.col("gap") < 0).cast("int")), 6).alias("pre"))


@query("era_age_medians", twin("SELECT CASE WHEN year < 1998 THEN 'early' ELSE 'late' END AS era, median(greatest(year - release_year, 0)) AS med FROM obs WHERE release_year IS NOT NULL GROUP BY 1", _OBS))
def era_age_medians(spark, d):
    o = _observations(spark, d).where("release_year is not null")
    return o.groupBy(F.when(F.col("year") < 1998, "early").otherwise("late").alias("era")).agg(F.median(F.greatest(F.col("year") - F.col("release_year"), F.lit(0))).alias("med"))


_RANKS = "ent AS (SELECT vendor, count(*) AS a, count(DISTINCT field) + count(DISTINCT model) AS b FROM obs GROUP BY vendor), rk AS (SELECT vendor, rank() OVER (ORDER BY a DESC) + (count(*) OVER (PARTITION BY a) - 1) / 2.0::DOUBLE AS ra, rank() OVER (ORDER BY b DESC) + (count(*) OVER (PARTITION BY b) - 1) / 2.0::DOUBLE AS rb FROM ent)"


def _ranks(spark, d):
    # A model has all of its rows in one task: its first row of a vendor counts it, and fields are few.
    per = _observations(spark, d).groupBy("vendor", "model", "field").agg(F.count("*").alias("n"))
    first = (F.row_number().over(Window.partitionBy("model", "vendor").orderBy("field")) == 1) & F.col("model").isNotNull()
    fields = per.withColumn("first", first.cast("int")).groupBy("vendor", "field").agg(F.sum("n").alias("n"), F.sum("first").alias("models"))
    ent = fields.groupBy("vendor").agg(F.sum("n").alias("a"), (F.count("field") + F.sum("models")).alias("b"))
    return ent.select("vendor", stats.average_rank(F.col("a")).alias("ra"), stats.average_rank(F.col("b")).alias("rb"))


@query("rank_compare", twin("SELECT * FROM rk", _OBS + ", " + _RANKS))
def rank_compare(spark, d):
    return _ranks(spark, d)


@query("rank_compare_spearman", twin("SELECT round(corr(ra, rb), 8) AS rho FROM rk", _OBS + ", " + _RANKS))
def rank_compare_spearman(spark, d):
    return _ranks(spark, d).agg(F.round(F.corr("ra", "rb"), 8).alias("rho"))


@query("frontier_range_join", twin("SELECT y.year, max(s.release_year) AS newest, max(s.fp32) AS best FROM (SELECT DISTINCT year FROM papers) y JOIN specs s ON s.release_year <= y.year GROUP BY y.year"))
def frontier_range_join(spark, d):
    # Best of each release year, then a running maximum: no row meets more than its own year.
    best = specs(spark, d).where("release_year is not null").groupBy("release_year").agg(F.max("fp32").alias("best"))
    years = papers(spark, d).select("year").distinct()
    line = best.select(F.col("release_year").alias("year"), F.col("release_year").alias("r"), "best", F.lit(False).alias("asked")).union(years.select("year", F.lit(None).cast("int"), F.lit(None).cast("double"), F.lit(True)))
    upto = Window.orderBy("year").rangeBetween(Window.unboundedPreceding, 0)
    return line.select("year", "asked", F.max("r").over(upto).alias("newest"), F.max("best").over(upto).alias("best")).where("asked").drop("asked")


@query("frontier_lag_topics", twin("SELECT field AS topic, count(*) AS n, median(year - release_year) AS lag FROM obs WHERE release_year IS NOT NULL GROUP BY field HAVING count(*) >= 30", _OBS))
def frontier_lag_topics(spark, d):
    o = _observations(spark, d).where("release_year is not null")
    return o.groupBy(F.col("field").alias("topic")).agg(F.count("*").alias("n"), F.median(F.col("year") - F.col("release_year")).alias("lag")).where("n >= 30")


@query("topic_composition", twin("SELECT field AS topic, vendor, n, round(n / sum(n) OVER (PARTITION BY field), 6) AS share FROM (SELECT field, vendor, count(DISTINCT paper) AS n FROM obs GROUP BY 1, 2)", _OBS))
def topic_composition(spark, d):
    n = observed_in_papers(spark, d, ("field",), ("vendor",)).groupBy(F.col("field").alias("topic"), "vendor").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("topic")), 6))


@query("hardware_age", twin("SELECT paper, mention, CAST(year - release_year AS INTEGER) AS age FROM enriched WHERE release_year IS NOT NULL"))
def hardware_age(spark, d):
    return enriched(spark, d).where("release_year is not null").select("paper", "mention", (F.col("year") - F.col("release_year")).alias("age"))


@query("stack_ratio", twin("SELECT year, count(*) FILTER (WHERE vendor = 'Brand#11') AS a, count(*) FILTER (WHERE vendor = 'Brand#22') AS b, round(count(*) FILTER (WHERE vendor = 'Brand#11')::DOUBLE / nullif(count(*) FILTER (WHERE vendor = 'Brand#22'), 0), 6) AS ratio FROM obs GROUP BY year", _OBS))
def stack_ratio(spark, d):
    a, b = F.count_if(F.col("vendor") == "Brand#11"), F.count_if(F.col("vendor") == "Brand#22")
    return _observations(spark, d).groupBy("year").agg(a.alias("a"), b.alias("b"), F.round(F.try_divide(a, b), 6).alias("ratio"))


@query("modal_month", twin("SELECT year, mode(month) AS month FROM (SELECT year, month, count(*) OVER (PARTITION BY year, month) AS c FROM papers) p WHERE (year, c) IN (SELECT year, max(c) FROM (SELECT year, count(*) AS c FROM papers GROUP BY year, month) GROUP BY year) GROUP BY year HAVING count(DISTINCT month) = 1 UNION ALL SELECT year, min(month) FROM (SELECT year, month, count(*) OVER (PARTITION BY year, month) AS c FROM papers) p WHERE (year, c) IN (SELECT year, max(c) FROM (SELECT year, count(*) AS c FROM papers GROUP BY year, month) GROUP BY year) GROUP BY year HAVING count(DISTINCT month) > 1"))
def modal_month(spark, d):
    return papers(spark, d).groupBy("year").agg(F.mode("month", True).alias("month"))


@query("gini_bootstrap")
def gini_bootstrap(spark, d):
    x = _prices(spark, d).withColumn("x", F.floor(F.col("x") / 1000) + 1)
    return stats.bootstrap_gini(x, ["year"], "x", replicates=200)


@query("half_life_bootstrap")
def half_life_bootstrap(spark, d):
    """95 % interval of each model's half-life under Poisson noise of its yearly counts."""
    yearly = _observations(spark, d).groupBy("model", "year").agg(F.count("*").alias("n"))
    return stats.half_life_intervals(yearly, "model", "year", "n")
