"""Paper-level capacity from mentions and specifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quern.functions.stats import nearest_quantile
from quern.operators.extract import USED

# Fixed values.
CAP_QUANTILE, CAP_LEAST, CAP_MOST = 0.999, 1, 65536
AXES = ("fp32", "fp64", "tensor")


def used_models(rows: DataFrame, years: DataFrame) -> DataFrame:
    """(paper, year, model, device_count, device_count_basis, memory_gb): mention rows (paper_id, status,
    usage_context, canonical_model and what the answer says) that are ok, in use and resolved, with
    ``years`` (paper_id, year); a paper without a year has a null one and the general cap."""
    used = rows.where((F.col("status") == "ok") & (F.col("usage_context") == USED) & F.col("canonical_model").isNotNull())
    return used.join(years, "paper_id", "left").select(F.col("paper_id").alias("paper"), "year", F.col("canonical_model").alias("model"), "device_count", "device_count_basis", F.col("memory_gb").cast("double").alias("memory_gb"))


def yearly_caps(mentions: DataFrame) -> DataFrame:
    """(year, cap): the 0.999 quantile of the stated device counts, within 1 and 65536."""
    caps = nearest_quantile(mentions, ["year"], "device_count", CAP_QUANTILE, "q")
    return caps.select("year", F.least(F.greatest("q", F.lit(CAP_LEAST)), F.lit(CAP_MOST)).alias("cap"))


def winsorised(mentions: DataFrame, policy: str = "floor1") -> DataFrame:
    """``mentions`` with n_dev: the count, at most the cap of its year.

    Policy ``explicit`` keeps only mentions whose count has an explicit basis and leaves a missing count
    null; under ``floor1`` all stay and a missing count is 1.  A count of 0 stays 0.
    """
    if policy not in ("floor1", "explicit"):
        raise ValueError(f"unknown policy {policy!r}")
    if policy == "explicit":
        mentions = mentions.where(F.col("device_count_basis") == "explicit")
    # One row per year: the planner broadcasts it after it has seen its size.
    capped = mentions.join(yearly_caps(mentions), "year", "left")
    n = F.least("device_count", F.coalesce("cap", F.lit(CAP_MOST)), F.lit(CAP_MOST)).cast("double")
    missing = F.lit(1.0) if policy == "floor1" else F.lit(None).cast("double")
    return capped.withColumn("n_dev", F.when(F.col("device_count").isNotNull(), n).otherwise(missing)).drop("cap")


def per_model(counted: DataFrame, specs: DataFrame) -> DataFrame:
    """One row per (paper, model): largest count and stated memory, with the model's specifications."""
    models = counted.groupBy("paper", "model").agg(F.max("n_dev").alias("n_dev"), F.max("memory_gb").alias("memory_gb"))
    return models.join(specs, "model", "left").withColumn("vram_eff", F.coalesce("memory_gb", "vram_gb"))


def paper_capacity(models: DataFrame, datacenter: str = "datacenter", consumer: str = "consumer") -> DataFrame:
    """One row per paper; ``datacenter`` and ``consumer`` name two segments.

    An axis adds what is known (a model without the specification adds nothing) and is null only if no
    model has it; power is null where unknown too.
    """
    def total(spec: str) -> Column:
        return F.sum(F.col("n_dev") * F.col(spec))

    sums = [total(a).alias(f"reported_{a}") for a in AXES] + [F.bool_and(F.col(a).isNull()).alias(f"spec_missing_{a}") for a in AXES]
    sums.append(F.bool_and(F.col("vram_eff").isNull()).alias("spec_missing_vram"))
    flag = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    return models.groupBy("paper").agg(
        *sums, total("vram_eff").alias("reported_vram"), total("tdp").alias("reported_tdp"), F.max("n_dev").alias("max_devices"), F.sum("n_dev").alias("total_devices"), F.countDistinct("model").alias("n_models"),
        F.max("release_year").alias("newest_release"), F.min("release_year").alias("oldest_release"), flag(F.col("segment") == datacenter).alias("any_datacenter"), flag(F.col("segment") == consumer).alias("any_consumer"), flag(F.col("tensor").isNotNull()).alias("tensor_capable"),
    )


def paper_flags(mentions: DataFrame, specific: Column | None = None) -> DataFrame:
    """One row per paper with an ok mention: what it mentions and what it uses.

    ``specific`` holds for mentions of a certain model; without it, of one with a release year."""
    specific = F.col("release_year").isNotNull() if specific is None else specific
    ok = mentions.where("status = 'ok'")
    used = F.col("usage_context") == USED
    flag = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    return ok.groupBy("paper").agg(
        F.lit(True).alias("accel_any"), flag(used).alias("accel_used"), flag(specific).alias("model_specific"), flag(used & specific).alias("model_specific_used"),
        F.count("*").alias("n_mentions"), F.countDistinct(F.when(specific, F.col("model"))).alias("n_models"), F.array_sort(F.collect_set("vendor")).alias("vendors"), F.array_sort(F.collect_set("usage_context")).alias("contexts"),
        F.max(F.when(used, F.col("release_year"))).alias("newest_used"), F.min(F.when(used, F.col("release_year"))).alias("oldest_used"), F.max(F.when(used, F.col("device_count"))).alias("max_device_count"),
    ).withColumn("generic_only", ~F.col("model_specific"))
