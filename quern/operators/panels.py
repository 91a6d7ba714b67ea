"""Tables per paper of a corpus: population, what papers mention, citations, capacity.

All take the corpus, whose key is the paper column of what they read and return.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quern.corpus import Corpus
from quern.operators import capacity, matching
from quern.operators.lexicon import Lexicon

# Makers that are told apart, and the last year with a whole window of citations.
MAKERS = ("nvidia", "amd", "intel", "google", "apple", "huawei", "graphcore", "cerebras", "amazon")
CITATION_CUTOFF = 2020


def keyed(corpus: Corpus, df: DataFrame) -> DataFrame:
    """``df`` with the key of the corpus; tables of the scan have it as the text ``paper_id``."""
    if corpus.key in df.columns:
        return df
    return df.withColumn(corpus.key, F.col("paper_id").try_cast(corpus.key_type)).drop("paper_id")


def denominator(corpus: Corpus, inventory: DataFrame, metadata: DataFrame) -> DataFrame:
    """The population: one row per paper of the inventory, with or without a mention, with year and field
    (null where the metadata lack the paper).  A paper that was scanned twice counts once."""
    facts = F.max(F.struct("body_chars", "has_body", "is_candidate")).alias("f")
    papers = keyed(corpus, inventory).groupBy(corpus.key).agg(facts).select(corpus.key, "f.has_body", "f.is_candidate", "f.body_chars")
    about = keyed(corpus, metadata).groupBy(corpus.key).agg(F.min(F.struct("year", "field")).alias("m")).select(corpus.key, "m.year", "m.field")
    return papers.join(about, corpus.key, "left")


def resolved(corpus: Corpus, mentions: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Mention rows with canonical names and the specification of the model."""
    dim = lexicon.specifications(mentions.sparkSession).select("canonical_model", "segment", "release_year")
    return matching.canonicalise(keyed(corpus, mentions), "model_normalized", lexicon).join(dim, "canonical_model", "left")


def enriched(corpus: Corpus, mentions: DataFrame, population: DataFrame, lexicon: Lexicon, contexts: tuple[str, ...] = (capacity.USED,)) -> DataFrame:
    """Mentions of the given contexts with canonical names and the paper's year and field."""
    rows = mentions.where((F.col("status") == "ok") & F.col("usage_context").isin(*contexts))
    return resolved(corpus, rows, lexicon).join(population.select(corpus.key, "year", "field"), corpus.key, "left")


def flags(corpus: Corpus, mentions: DataFrame, lexicon: Lexicon) -> DataFrame:
    """One row per paper with an ok mention; makers outside of the fixed list are left out of ``vendors``."""
    rows = resolved(corpus, mentions, lexicon).withColumnsRenamed({corpus.key: "paper", "canonical_model": "model"})
    rows = rows.withColumn("vendor", F.when(F.col("manufacturer").isin(*MAKERS), F.col("manufacturer")))
    out = capacity.paper_flags(rows, F.coalesce(F.col("canonical_kind") == "model", F.lit(False)))
    subtypes = rows.where("status = 'ok'").groupBy("paper").agg(F.array_sort(F.collect_set("accelerator_subtype")).alias("subtypes"))
    return out.join(subtypes, "paper").withColumnRenamed("paper", corpus.key)


def citations(corpus: Corpus, focal: DataFrame, outcomes: DataFrame, cutoff: int = CITATION_CUTOFF) -> DataFrame:
    """(key, year, i_1, i_3, citations_5y, i_10, disruption_5y, cd_10, bcites_300, window_complete, has_outcomes)
    of the focal papers (key, year) that have a year.  Papers without outcomes stay, marked."""
    if not corpus.citations:
        raise ValueError(f"no citations are known for {corpus.name}")
    kept = ("i_1", "i_3", "i_5", "i_10", "cd_5", "cd_10", "bcites_300")
    known = outcomes.select(F.col("record_id").try_cast(corpus.key_type).alias(corpus.key), *kept).where(F.col(corpus.key).isNotNull())
    rows = focal.where("year is not null").select(corpus.key, "year").join(known, corpus.key, "left")
    named = rows.withColumnsRenamed({"i_5": "citations_5y", "cd_5": "disruption_5y"})
    return named.withColumn("window_complete", F.col("year") <= cutoff).withColumn("has_outcomes", F.col("citations_5y").isNotNull())


def reported_capacity(corpus: Corpus, mentions: DataFrame, years: DataFrame, lexicon: Lexicon, policy: str = "floor1", mentions_version: str | None = None) -> DataFrame:
    """Capacity per paper with its year and what it was made from (policy, versions)."""
    spark = mentions.sparkSession
    papers = keyed(corpus, years).groupBy(F.col(corpus.key).alias("paper_id")).agg(F.min("year").alias("year"))
    names = matching.canonicalise(keyed(corpus, mentions), "model_normalized", lexicon).withColumnRenamed(corpus.key, "paper_id")
    counted = capacity.winsorised(capacity.used_models(names, papers), policy).where(F.col("n_dev").isNotNull())
    specs = lexicon.specifications(spark).select(
        F.col("canonical_model").alias("model"), "display", F.col("manufacturer").alias("vendor"), "segment", "release_year",
        F.col("fp32_gflops").alias("fp32"), F.col("fp64_gflops").alias("fp64"), F.col("fp16_tensor_gflops").alias("tensor"), "vram_gb", F.col("tdp_w").alias("tdp"),
    )
    out = capacity.paper_capacity(capacity.per_model(counted, specs)).withColumnRenamed("paper", "paper_id").join(papers, "paper_id", "left")
    return stamped(out, count_policy=policy, spec_registry_version=lexicon.version, mentions_registry_version=mentions_version).withColumnRenamed("paper_id", corpus.key)


def coverage(papers: DataFrame, columns: list[str]) -> DataFrame:
    """One row: share of papers that have each column, null for an empty table."""
    return papers.agg(*[F.avg(F.col(c).isNotNull().cast("int")).alias(c) for c in columns])


def stamped(df: DataFrame, **facts: str | None) -> DataFrame:
    """``df`` with constant text columns that say what it was made from."""
    return df.withColumns({k: F.lit(v).cast("string") for k, v in facts.items()})


def share_by(df: DataFrame, by: list[str], flag: Column, out: str) -> DataFrame:
    """Share of rows for which ``flag`` holds."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.coalesce(flag, F.lit(False)).cast("int")).alias(out))
