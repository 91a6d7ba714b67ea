"""Statistics of groups.

Everything that needs ranks first counts equal values (combined before the shuffle), so the windows run
over different values, not over rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F


def _counted(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, value, c, upto, n): c rows of the value, upto of it or lower ones, n of the group."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    group = Window.partitionBy(*by)
    upto = group.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumn("upto", F.sum("c").over(upto)).withColumn("n", F.sum("c").over(group))


def nearest_quantile(df: DataFrame, by: list[str], value: str, q: float, out: str) -> DataFrame:
    """The element at place round((n-1) q) of the ascending non-null values, halves upwards."""
    place = F.floor((F.col("n") - 1) * F.lit(q) + 0.5)
    return _counted(df, by, value).where((F.col("upto") > place) & (F.col("upto") - F.col("c") <= place)).select(*by, F.col(value).alias(out))


def gini(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Sum of (2i - n - 1) x over n times the total, by ascending rank i; null for a zero total."""
    weight = F.col("c") * (2 * F.col("upto") - F.col("c") - F.col("n"))
    return _counted(df, by, value).groupBy(*by).agg(F.max("n").alias("n"), F.try_divide(F.sum(F.col(value) * weight), F.max("n") * F.sum(F.col(value) * F.col("c"))).alias("gini"))


def top_share(df: DataFrame, by: list[str], value: str, share: float) -> DataFrame:
    """Share of the total held by the round(share n) largest rows (half to even, one at least)."""
    k = F.greatest(F.lit(1), F.bround(F.col("n") * F.lit(share)).cast("long"))
    taken = F.greatest(F.lit(0), F.least(F.col("c"), k - (F.col("n") - F.col("upto"))))
    return _counted(df, by, value).groupBy(*by).agg(F.max("n").alias("n"), F.try_divide(F.sum(taken * F.col(value)), F.sum(F.col("c") * F.col(value))).alias("top_share"))


def lorenz(df: DataFrame, by: list[str], value: str, least_rows: int = 1) -> DataFrame:
    """Points (population share, value share) of the positive values, with (0, 0), a point per
    different value."""
    counted = _counted(df.where(F.col(value) > 0), by, value).where(F.col("n") >= least_rows)
    group = Window.partitionBy(*by)
    cum = group.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    mass = F.col("c") * F.col(value)
    points = counted.select(*by, (F.col("upto") / F.col("n")).alias("p"), (F.sum(mass).over(cum) / F.sum(mass).over(group)).alias("share"))
    return points.union(counted.select(*by, F.lit(0.0), F.lit(0.0)).distinct())


def theil(df: DataFrame, by: list[str], group: str, value: str, least_rows: int = 1) -> DataFrame:
    """(by, n, total, between, within): Theil's T of positive values and its parts by ``group``."""
    x = df.where(F.col(value) > 0)
    inner = x.groupBy(*by, group).agg(F.count("*").alias("ng"), F.sum(value).alias("sg"), F.sum(F.col(value) * F.ln(value)).alias("sl"))
    whole = inner.groupBy(*by).agg(F.sum("ng").alias("n"), F.sum("sg").alias("s")).where(F.col("n") >= least_rows)
    joined = inner.join(whole, by).withColumn("part", F.col("sg") / F.col("s"))
    ratio = F.ln((F.col("sg") / F.col("ng")) / (F.col("s") / F.col("n")))
    own = F.col("sl") / F.col("sg") - F.ln(F.col("sg") / F.col("ng"))
    return joined.groupBy(*by).agg(F.max("n").alias("n"), F.sum(F.col("part") * (ratio + own)).alias("total"), F.sum(F.col("part") * ratio).alias("between"), F.sum(F.col("part") * own).alias("within"))


def concentration(df: DataFrame, by: list[str], group: str, value: str) -> DataFrame:
    """(by, vendors, hhi, entropy): of shares made to add up to one; entropy is over its largest
    value, 0 for a single vendor."""
    share = F.col(value) / F.sum(value).over(Window.partitionBy(*by))
    shares = df.where(F.col(value) > 0).withColumn("s", share)
    entropy = -F.sum(F.col("s") * F.ln("s"))
    n = F.count("*")
    return shares.groupBy(*by).agg(n.alias("vendors"), F.sum(F.col("s") * F.col("s")).alias("hhi"), F.when(n > 1, entropy / F.ln(n)).otherwise(0.0).alias("entropy"))


def three_tap(value: Column, by: list[str], order: str) -> Column:
    """Sum of a row and its neighbours, missing ones zero: three times the smoothed value."""
    w = Window.partitionBy(*by).orderBy(order)
    return F.coalesce(F.lag(value).over(w), F.lit(0)) + value + F.coalesce(F.lead(value).over(w), F.lit(0))


def half_life(yearly: DataFrame, by: str, order: str, value: str, least_rows: int = 4) -> DataFrame:
    """(by, peak, half, years): years from the first peak of the smoothed series to the first later row
    that is, with the next one, at most half of the peak; null if that never happens."""
    series = yearly.withColumn("sm", three_tap(F.col(value), [by], order))
    w = Window.partitionBy(by)
    ordered = w.orderBy(order)
    peaks = series.withColumn("rows", F.count("*").over(w)).where(F.col("rows") >= least_rows).withColumn("nth", F.row_number().over(w.orderBy(F.desc("sm"), order))).withColumn("next", F.lead("sm").over(ordered))
    peak = peaks.withColumn("peak", F.max(F.when(F.col("nth") == 1, F.col(order))).over(w)).withColumn("top", F.max("sm").over(w))
    crossed = F.when((F.col(order) > F.col("peak")) & (2 * F.col("sm") <= F.col("top")) & (2 * F.col("next") <= F.col("top")), F.col(order))
    return peak.groupBy(by).agg(F.max("peak").alias("peak"), F.min(crossed).alias("half")).withColumn("years", F.col("half") - F.col("peak"))


_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotated(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def xxhash_int(value: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of one more int column, over the hash ``seed`` of those before it (42 at first)."""
    h = (seed + _P5 + np.uint64(4)) ^ ((value.astype(np.int64).view(np.uint64) & np.uint64(0xFFFFFFFF)) * _P1)
    return _mixed(_rotated(h, 23) * _P2 + _P3)


def xxhash_long(value: np.ndarray, seed: np.ndarray) -> np.ndarray:
    h = (seed + _P5 + np.uint64(8)) ^ (_rotated(value.astype(np.int64).view(np.uint64) * _P2, 31) * _P1)
    return _mixed(_rotated(h, 27) * _P1 + _P4)


def _percentile(values: np.ndarray, share: float) -> float | None:
    """Of ascending values, between the two next to the place as Spark's exact percentile does."""
    if not len(values):
        return None
    place = (len(values) - 1) * share
    low, high = int(np.floor(place)), int(np.ceil(place))
    if low == high or values[low] == values[high]:
        return float(values[low])
    return float((high - place) * values[low] + (place - low) * values[high])


#: Numbers of one array in drawing: replicates of this many series at a time.
DRAWN_AT_ONCE = 1 << 18


def half_life_intervals(yearly: DataFrame, by: str, order: str, value: str, replicates: int = 50, least_rows: int = 4) -> DataFrame:
    """(by, low, high, uncensored): 95 % interval of ``half_life`` under Poisson noise (normal approximation) of
    the values, over the replicates that have one.

    ``by`` is a bigint, ``order`` an int; a null one hashes as nothing and stands first.  A series is one row and its replicates
    are drawn where it lies: nothing but the series is shuffled, however many replicates there are.  The
    draws are hashes of (by, order, replicate)."""
    series = yearly.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).cast("int").alias("o"), F.col(value).cast("bigint").alias("v")))).alias("s")).where(F.size("s") >= least_rows)
    flat = series.select(F.col(by).cast("bigint").alias(by), F.col("s.o").alias("o"), F.col("s.v").alias("v"))

    def of_length(keys: np.ndarray, no_key: np.ndarray, years: np.ndarray, no_year: np.ndarray, counts: np.ndarray) -> tuple[list, list, list]:
        r = np.arange(1, replicates + 1)[None, :, None]
        seed = np.full((1, 1, 1), 42, np.uint64)
        by_key = lambda h: np.where(no_key[:, None, None], h, xxhash_long(keys[:, None, None], h))
        by_year = lambda h: np.where(no_year[:, None, :], h, xxhash_int(years[:, None, :], h))
        share = lambda h: ((h & np.uint64((1 << 40) - 1)).astype(np.float64) + 0.5) / float(1 << 40)
        u = share(xxhash_int(r, by_year(by_key(seed))))
        v = share(by_key(by_year(xxhash_int(r, seed))))
        n = counts[:, None, :].astype(np.float64)
        x = n + np.sqrt(n) * (np.sqrt(-2 * np.log(u)) * np.cos(2 * 3.141592653589793 * v))
        whole = np.floor(x)
        drawn = np.maximum(whole + (x - whole >= 0.5), 0)
        smooth = drawn.copy()
        smooth[:, :, 1:] += drawn[:, :, :-1]
        smooth[:, :, :-1] += drawn[:, :, 1:]
        at = smooth.argmax(axis=2)  # the first of the largest
        top = smooth.max(axis=2, keepdims=True)
        low = 2 * smooth <= top
        crossed = np.zeros_like(low)
        crossed[:, :, :-1] = low[:, :, :-1] & low[:, :, 1:] & (np.arange(years.shape[1] - 1) > at[:, :, None])
        half = crossed.argmax(axis=2)
        rows = np.arange(len(keys))[:, None]
        lives = np.where(crossed.any(axis=2) & ~no_year[rows, at], years[rows, half] - years[rows, at], np.iinfo(np.int64).max)
        lives.sort(axis=1)
        found = (lives < np.iinfo(np.int64).max).sum(axis=1)
        sides = [[_percentile(one[:n], q) for one, n in zip(lives, found, strict=True)] for q in (0.025, 0.975)]
        return *sides, found.tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain = lambda x: (x.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), x.is_null().to_numpy(zero_copy_only=False))
            keys, no_key = plain(batch.column(0))
            (years, no_year), (counts, _) = plain(batch.column(1).values), plain(batch.column(2).values)
            starts = batch.column(1).offsets.to_numpy()
            begins, lengths = starts[:-1], np.diff(starts)
            for length in np.unique(lengths):
                alike = np.flatnonzero(lengths == length)
                step = max(1, DRAWN_AT_ONCE // (int(length) * replicates))
                for part in (alike[i : i + step] for i in range(0, len(alike), step)):
                    places = begins[part][:, None] + np.arange(length)
                    low, high, found = of_length(keys[part], no_key[part], years[places], no_year[places], counts[places])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(part)), pa.array(low, pa.float64()), pa.array(high, pa.float64()), pa.array(found, pa.int64())], names=[by, "low", "high", "uncensored"])

    return flat.mapInArrow(run, f"{by} bigint, low double, high double, uncensored bigint")


def average_rank(value: Column, by: list[str] | None = None) -> Column:
    """Descending rank from 1; ties share the mean of their places.  Over one table of entities."""
    w = Window.partitionBy(*(by or [F.lit(0)]))
    return F.rank().over(w.orderBy(value.desc())) + (F.count("*").over(w.partitionBy(*(by or []), value) if by else Window.partitionBy(value)) - 1) / 2


def bootstrap_gini(df: DataFrame, by: list[str], value: str, replicates: int = 300, seed: int = 0) -> DataFrame:
    """(by, low, high): 95 % interval of the Gini index by a Poisson bootstrap.

    Every different value of a group draws its weight of each replicate; replicates are rows, so their
    number, not a group's, decides how many rows there are per value.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    reps = counted.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    # Poisson(c) by its normal approximation above 30 and by inversion below.
    u = (F.pmod(F.xxhash64(*by, value, "rep", F.lit(seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    v = (F.pmod(F.xxhash64(*by, value, "rep", F.lit(seed + 1)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    normal = F.sqrt(-2 * F.ln(u)) * F.cos(2 * 3.141592653589793 * v)
    start = F.struct(F.exp(-F.col("c").cast("double")).alias("p"), F.exp(-F.col("c").cast("double")).alias("s"), F.lit(0).alias("k"))
    step = lambda s, i: F.when(u > s["s"], F.struct((s["p"] * F.col("c") / i).alias("p"), (s["s"] + s["p"] * F.col("c") / i).alias("s"), i.alias("k"))).otherwise(s)
    small = F.aggregate(F.sequence(F.lit(1), F.lit(100)), start, step)["k"]
    weight = F.when(F.col("c") > 30, F.greatest(F.lit(0), F.round(F.col("c") + F.sqrt("c") * normal).cast("int"))).otherwise(small)
    drawn = reps.withColumn("w", weight).where("w > 0")
    group = Window.partitionBy(*by, "rep")
    upto = group.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = drawn.withColumn("upto", F.sum("w").over(upto)).withColumn("n", F.sum("w").over(group))
    per = ranked.groupBy(*by, "rep").agg(F.try_divide(F.sum(F.col(value) * F.col("w") * (2 * F.col("upto") - F.col("w") - F.col("n"))), F.max("n") * F.sum(F.col(value) * F.col("w"))).alias("__gini"))
    return per.groupBy(*by).agg(F.percentile("__gini", F.lit(0.025)).alias("low"), F.percentile("__gini", F.lit(0.975)).alias("high"))
