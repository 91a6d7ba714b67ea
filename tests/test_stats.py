from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from quern.functions import stats
from quern.operators import capacity


def frame(spark, values, kind="bigint"):
    return spark.createDataFrame([("g", v) for v in values], f"g string, x {kind}")


def test_gini_by_definition(spark):
    rng = random.Random(1)
    xs = [rng.randint(0, 20) for _ in range(200)]
    n = len(xs)
    want = sum((2 * i - n - 1) * x for i, x in enumerate(sorted(xs), 1)) / (n * sum(xs))
    assert math.isclose(stats.gini(frame(spark, xs), ["g"], "x").first()["gini"], want)
    assert stats.gini(frame(spark, [0, 0]), ["g"], "x").first()["gini"] is None


def test_nearest_quantile(spark):
    assert stats.nearest_quantile(frame(spark, range(1, 11)), ["g"], "x", 0.9, "q").first()["q"] == 9
    assert stats.nearest_quantile(frame(spark, [1, 2]), ["g"], "x", 0.5, "q").first()["q"] == 2
    assert stats.nearest_quantile(frame(spark, [7, None]), ["g"], "x", 0.999, "q").first()["q"] == 7


def test_top_share_rounds_half_to_even(spark):
    xs = list(range(1, 251))  # 2.5 rows: two
    assert math.isclose(stats.top_share(frame(spark, xs), ["g"], "x", 0.01).first()["top_share"], (250 + 249) / sum(xs))


def test_theil_adds_up(spark):
    rng = random.Random(2)
    rows = [("g", f"t{rng.randint(0, 3)}", float(rng.randint(1, 50))) for _ in range(300)]
    got = stats.theil(spark.createDataFrame(rows, "g string, t string, x double"), ["g"], "t", "x").first()
    mu = sum(r[2] for r in rows) / len(rows)
    want = sum(r[2] / mu * math.log(r[2] / mu) for r in rows) / len(rows)
    assert math.isclose(got["total"], want) and math.isclose(got["between"] + got["within"], want)


def by_hand(series):
    """Peak and first confirmed crossing of the unscaled three-tap sums."""
    sm = [(series[k - 1] if k else 0) + series[k] + (series[k + 1] if k + 1 < len(series) else 0) for k in range(len(series))]
    peak = sm.index(max(sm))
    half = next((k for k in range(peak + 1, len(sm) - 1) if 2 * sm[k] <= sm[peak] and 2 * sm[k + 1] <= sm[peak]), None)
    return peak, half


def test_half_life(spark):
    rng = random.Random(3)
    series = {f"m{k}": [rng.randint(0, 30) for _ in range(rng.randint(2, 10))] for k in range(60)}
    rows = [(m, 2000 + y, n) for m, s in series.items() for y, n in enumerate(s)]
    got = {r["m"]: r for r in stats.half_life(spark.createDataFrame(rows, "m string, y int, n bigint"), "m", "y", "n").collect()}
    assert set(got) == {m for m, s in series.items() if len(s) >= 4}
    for m, row in got.items():
        peak, half = by_hand(series[m])
        assert (row["peak"], row["half"]) == (2000 + peak, None if half is None else 2000 + half)


def test_bootstrap_interval_holds_the_index(spark):
    xs = [k % 50 + 1 for k in range(2000)]
    low, high = (stats.bootstrap_gini(frame(spark, xs), ["g"], "x", 100).first()[c] for c in ("low", "high"))
    assert low < stats.gini(frame(spark, xs), ["g"], "x").first()["gini"] < high and high - low < 0.05


def test_winsorising(spark):
    rows = [("p", 1, 2000, n, "explicit") for n in (1, 2, None, 0, 10**6)] + [("q", 1, 2001, 5, "inferred")]
    m = spark.createDataFrame(rows, "paper string, mention int, year int, device_count bigint, device_count_basis string")
    assert sorted(r["n_dev"] for r in capacity.winsorised(m).collect()) == [0.0, 1.0, 1.0, 2.0, 5.0, 65536.0]
    assert sorted((r["n_dev"] for r in capacity.winsorised(m, "explicit").collect()), key=lambda x: (x is None, x)) == [0.0, 1.0, 2.0, 65536.0, None]


def test_capacity_adds_what_is_known(spark):
    models = spark.createDataFrame(
        [("p", 1, 2.0, None, "STANDARD", 2001, 10.0, None, None, 4.0, None, 4.0), ("p", 2, 1.0, None, "SMALL", None, None, None, 1.0, None, None, None)],
        "paper string, model int, n_dev double, memory_gb double, segment string, release_year int, fp32 double, fp64 double, tensor double, vram_gb double, tdp double, vram_eff double",
    )
    row = capacity.paper_capacity(models, "STANDARD", "SMALL").first()
    assert (row["reported_fp32"], row["reported_fp64"], row["reported_tensor"], row["reported_tdp"]) == (20.0, None, 1.0, None)
    assert row["spec_missing_fp64"] and not row["spec_missing_fp32"] and row["any_datacenter"] and row["any_consumer"]


def test_half_life_intervals(spark):
    """Series in arrays against one row per replicate, with the draws of Spark's own hash."""
    rows = [(m, y, (m * 37 + y * 11) % 40 + (60 if y == 1996 + m % 2 else 0)) for m in range(60) for y in range(1995, 1997 + m % 7)]
    rows += [(None, y, 70 - 9 * (y - 1995)) for y in range(1995, 2001)] + [(7, None, 90), (9, None, 5)]
    yearly = spark.createDataFrame(rows, "m bigint, y int, n bigint")
    drawn = yearly.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(50))))
    u = (F.pmod(F.xxhash64("m", "y", "rep"), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    v = (F.pmod(F.xxhash64("rep", "y", "m"), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    noise = F.sqrt(-2 * F.ln(u)) * F.cos(2 * 3.141592653589793 * v)
    moved = drawn.select(F.struct("m", "rep").alias("key"), "y", F.greatest(F.lit(0), F.round(F.col("n") + F.sqrt("n") * noise)).cast("bigint").alias("n"))
    want = stats.half_life(moved, "key", "y", "n").groupBy(F.col("key.m").alias("m")).agg(F.percentile("years", F.lit(0.025)).alias("low"), F.percentile("years", F.lit(0.975)).alias("high"), F.count("years").alias("uncensored"))
    got = stats.half_life_intervals(yearly, "m", "y", "n")
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert any(r["uncensored"] for r in got.collect())


def test_terms_are_counted_over_runs(spark, monkeypatch):
    """Key words from counts that leave the workers in many runs, against plain counts."""
    from collections import Counter

    from quern.operators import topics

    monkeypatch.setattr(topics, "TERMS_AT_ONCE", 40)
    rng = random.Random(3)
    rows = [(k % 3, " ".join(rng.choice(("Alpha", "beta", "gamma", "x", "delta", "eps")) for _ in range(rng.randint(0, 30)))) for k in range(120)] + [(1, None)]
    frame = spark.createDataFrame(rows, "t int, text string").coalesce(1)
    counted = topics._term_counts(frame.select("t", F.lower("text").alias("text")), ("gamma",))
    tf, df = Counter(), Counter()
    for t, text in rows:
        words = [w for w in (text or "").lower().split() if len(w) > 1 and w != "gamma"]
        terms = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
        tf.update((t, w) for w in terms)
        df.update((t, w) for w in set(terms))
    assert counted.count() > len(tf)
    summed = {(r["t"], r["term"]): (r["tf"], r["df"]) for r in counted.groupBy("t", "term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df")).collect()}
    assert summed == {k: (tf[k], df[k]) for k in tf}
