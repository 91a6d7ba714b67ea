"""Embeddings of papers: the work list and a pluggable encoder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quern.functions.text import embedding_text

LEAST_ABSTRACT = 20
BATCH = 64


def worklist(mentions: DataFrame, abstracts: DataFrame, titles: DataFrame, key: str) -> DataFrame:
    """(key, text) of the papers with an ok mention and an abstract of over 20 characters."""
    wanted = mentions.where("status = 'ok'").select(key).distinct()
    found = abstracts.where(F.length("abstract") > LEAST_ABSTRACT).select(key, "abstract").join(wanted, key, "left_semi")
    return found.join(titles.select(key, "title"), key, "left").select(key, embedding_text(F.col("title"), F.col("abstract")).alias("text"))


def encode(texts: DataFrame, key: str, load: Callable[[], Callable[[list[str]], list[list[float]]]], size: int) -> DataFrame:
    """(key, embedding): the encoder is loaded once per task and called with batches of texts.

    A vector of another length than ``size`` is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for whole in batches:
            encoder = encoder or load()
            for at in range(0, whole.num_rows, BATCH):
                batch = whole.slice(at, BATCH)
                vectors = encoder(batch.column(1).to_pylist())
                if any(len(v) != size for v in vectors):
                    raise ValueError(f"the encoder must give {size} numbers")
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vectors, pa.list_(pa.float32()))], names=[key, "embedding"])

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, "text").mapInArrow(run, f"{key} {kind}, embedding array<float>")


def aligned(embeddings: DataFrame, abstracts: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """(key, vector, text): one row per key of all chunks (of repeated keys the least vector) with its
    abstract, empty where there is none."""
    once = embeddings.groupBy(key).agg(F.min(vector).alias(vector))
    texts = abstracts.groupBy(key).agg(F.min("abstract").alias("abstract"))
    return once.join(texts, key, "left").select(key, vector, F.coalesce("abstract", F.lit("")).alias("text"))


def hashing_encoder(size: int) -> Callable[[], Callable[[list[str]], list[list[float]]]]:
    """A deterministic stand-in for a model: signed counts of hashed words, of unit length."""

    def load():
        import math
        import zlib

        def one(text: str) -> list[float]:
            out = [0.0] * size
            for word in (text or "").lower().split():
                h = zlib.crc32(word.encode())
                out[h % size] += 1.0 if h >> 16 & 1 else -1.0
            norm = math.sqrt(sum(x * x for x in out)) or 1.0
            return [x / norm for x in out]

        return lambda texts: [one(t) for t in texts]

    return load
