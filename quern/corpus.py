"""Corpora and where their products lie."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from quern.functions.text import version_parts

PRODUCTS = ("inventory", "candidates", "ingest", "passages", "manifest", "mentions", "capacity", "analytic", "precision", "embeddings", "clusters")
#: What each product is partitioned by, in order; inventories do not depend on the lexicon.
PARTITIONS = {
    "inventory": (), "ingest": (), "candidates": ("registry_version",), "passages": ("registry_version",), "manifest": ("registry_version",), "precision": ("registry_version",),
    "mentions": ("registry_version", "prompt_version", "model_tag"), "capacity": ("registry_version", "prompt_version", "model_tag"), "analytic": ("registry_version", "prompt_version", "model_tag"),
    "embeddings": ("model_tag",), "clusters": ("model_tag",),
}


@dataclass(frozen=True)
class Corpus:
    name: str
    key: str
    key_type: str
    citations: bool = False

    def path(self, root: str, product: str, **version: str) -> str:
        """Folder of a product: root/product/corpus=.../partition=.../..."""
        if product not in PARTITIONS:
            raise ValueError(f"unknown product {product!r}")
        missing = [p for p in PARTITIONS[product] if p not in version]
        if missing:
            raise ValueError(f"{product} needs {', '.join(missing)}")
        parts = "".join(f"/{p}={version[p]}" for p in PARTITIONS[product])
        return f"{root.rstrip('/')}/{product}/corpus={self.name}{parts}"


CORPORA = {c.name: c for c in (Corpus("s2orc", "corpusid", "bigint", citations=True), Corpus("arxiv", "paper_id", "string"))}


def get_corpus(name: str) -> Corpus:
    try:
        return CORPORA[name]
    except KeyError:
        raise ValueError(f"unknown corpus {name!r}; known: {', '.join(sorted(CORPORA))}") from None


def latest_version(spark: SparkSession, root: str, product: str, corpus: Corpus, unique: bool = False) -> str:
    """The highest version of a product by its numbers (0.10.0 is above 0.9.0); an error if there is
    none, or more than one where it must be ``unique``."""
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{product}/corpus={corpus.name}")
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [str(s.getPath().getName()) for s in fs.listStatus(base)] if fs.exists(base) else []
    found = [n.removeprefix("registry_version=") for n in names if n.startswith("registry_version=")]
    if not found:
        raise FileNotFoundError(f"no version of {product} below {root}")
    if unique and len(found) > 1:
        raise ValueError(f"several versions of {product}: {', '.join(sorted(found))}")
    frame = spark.createDataFrame([(v,) for v in found], "v string")
    return frame.agg(F.max_by("v", version_parts(F.col("v")))).first()[0]


def pending(requested: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Requested shards that no completion row has; with a digest among the keys, a changed shard is
    pending again."""
    return requested.join(done, keys, "left_anti")
