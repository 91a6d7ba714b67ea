"""Mixing sources to target weights.

The documents of a source are packed, one after the other, into blocks of a fixed number of words.
The mix is a sequence of slots, cut into output shards, and every slot takes one block.  Source
counts of the shards are multinomial draws, conditioned on the totals that the targets ask for: the
slots of all shards are halved again and again and each half draws its counts from what its parent
has (multivariate hypergeometric).  Any shard can be drawn alone from the seed, in logarithmic time.
The n-th slot of a source takes the block at place n of a pseudorandom permutation of the source's
blocks, a new permutation for every pass over the source, and slots meet blocks in a join by index.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quern.llm.numbering import CHUNKS, with_offsets
from quern.llm.storage import materialize, small_batches, unused
from quern.llm.words import WHITE_SPACE, WORD_REGEX

#: Weights of the sources by code point, repeating.
WEIGHTS = (5, 2, 1)
#: A source is taken this many times at most.
MAX_PASSES = 3
BLOCK_WORDS = 128
SLOTS_PER_SHARD = 1024
SEED = 20
#: Slots that are drawn together, about: the draws need fewer than 10**9.  Every such part of the mix has
#: its share of every source.
SLOTS_PER_PART = 1 << 26


@dataclass(frozen=True)
class Source:
    number: int
    name: str | None
    size: int
    target: float
    blocks: int
    slots: int


@dataclass(frozen=True)
class MixPlan:
    """What the mix takes of every source; one entry per source name, never per document."""

    sources: tuple[Source, ...]
    block_words: int
    slots_per_shard: int
    seed: int

    @property
    def slots(self) -> int:
        return sum(s.slots for s in self.sources)

    def parts(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first shard, first slot, slots before by source, slots by source) of the parts of the mix."""
        n, shard, slot = -(-self.slots // SLOTS_PER_PART), 0, 0
        for k in range(n):
            before = np.array([s.slots * k // n for s in self.sources], np.int64)
            counts = np.array([s.slots * (k + 1) // n for s in self.sources], np.int64) - before
            yield shard, slot, before, counts
            shard, slot = shard - (-int(counts.sum()) // self.slots_per_shard), slot + int(counts.sum())

    @property
    def shards(self) -> int:
        return sum(-(-int(counts.sum()) // self.slots_per_shard) for _, _, _, counts in self.parts())


def share_targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, passes: int = MAX_PASSES) -> list[float]:
    """Targets by weight that add up to all sizes; where one is above ``passes`` times its size it
    stops there and the rest is shared anew among the others, until none is above."""
    weight = [weights[k % len(weights)] for k in range(len(sizes))]
    total, full = sum(sizes), set()
    while True:
        rest = total - sum(passes * sizes[k] for k in full)
        over = sum(w for k, w in enumerate(weight) if k not in full)
        targets = [float(passes * sizes[k]) if k in full else rest * w / over for k, w in enumerate(weight)]
        above = {k for k in range(len(sizes)) if k not in full and targets[k] > passes * sizes[k]}
        if not above:
            return targets
        full |= above


def plan_mix(sizes: DataFrame, source_col: str, size_col: str, block_words: int = BLOCK_WORDS, slots_per_shard: int = SLOTS_PER_SHARD, seed: int = SEED) -> MixPlan:
    """The plan for documents with word counts; collects one row per source."""
    rows = sizes.groupBy(source_col).agg(F.sum(size_col).alias("n")).collect()
    found = sorted(((r[0], int(r[1] or 0)) for r in rows), key=lambda r: (r[0] is None, r[0] or ""))
    targets, sources = share_targets([n for _, n in found]), []
    for k, ((name, n), target) in enumerate(zip(found, targets, strict=True)):
        blocks = -(-n // block_words)
        whole = min(MAX_PASSES, int(target // n)) if n else 0
        part = min(blocks, round((target - whole * n) / block_words)) if whole < MAX_PASSES else 0
        sources.append(Source(k, name, n, target, blocks, whole * blocks + part))
    return MixPlan(tuple(sources), block_words, slots_per_shard, seed)


def shard_counts(plan: MixPlan, low: int, high: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(shard, its first slot, slots before it by source, its slots by source) for the shards in [low, high)."""
    size = plan.slots_per_shard

    def walk(origin: tuple[int, int], first: int, last: int, before: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        if origin[0] + last <= low or origin[0] + first >= high:
            return
        if last - first == 1:
            yield origin[0] + first, origin[1] + first * size, before, counts
            return
        middle = (first + last) // 2
        rng = np.random.default_rng([plan.seed, origin[0] + first, origin[0] + last])
        left = rng.multivariate_hypergeometric(counts, (middle - first) * size, method="marginals")
        yield from walk(origin, first, middle, before, left)
        yield from walk(origin, middle, last, before + left, counts - left)

    for shard, slot, before, counts in plan.parts():
        yield from walk((shard, slot), 0, -(-int(counts.sum()) // size), before, counts)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(places: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The images of ``places`` under a pseudorandom permutation of range(n).

    A Feistel network permutes the least square of a power of two that holds the range; an image
    outside of the range is permuted again.
    """
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = _mixed(np.uint64(seed % (1 << 63)) + np.arange(1, 7, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & mask
        for key in keys:
            left, right = right, left ^ (_mixed(right + key) & mask)
        return left << shift | right

    out = once(places.astype(np.uint64))
    while (outside := out >= np.uint64(n)).any():
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def slot_table(spark: SparkSession, plan: MixPlan) -> DataFrame:
    """Rows (out_shard int, slot long, source_no int, block long, pass int): all slots of the mix."""

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            for shard, first_slot, before, counts in shard_counts(plan, int(batch["id"].iloc[0]), int(batch["id"].iloc[-1]) + 1):
                number, block, turn = [], [], []
                for source in np.nonzero(counts)[0].tolist():
                    n = plan.sources[source].blocks
                    place = before[source] + np.arange(counts[source])
                    passes, found = place // n, np.empty(len(place), np.int64)
                    for p in np.unique(passes).tolist():
                        found[passes == p] = permuted(place[passes == p] % n, n, hash((plan.seed, source, p)))
                    number.append(np.full(len(place), source, np.int32))
                    block.append(found)
                    turn.append(passes.astype(np.int32))
                order = np.random.default_rng([plan.seed, shard]).permutation(int(counts.sum()))
                yield pd.DataFrame({"out_shard": np.int32(shard), "slot": first_slot + np.arange(len(order)), "source_no": np.concatenate(number)[order], "block": np.concatenate(block)[order], "pass": np.concatenate(turn)[order]})

    # The planner takes the slots for as few as the shards that they are made of and would broadcast
    # them: they grow with the corpus, so they are always joined by a shuffle.
    ids = spark.range(0, plan.shards, numPartitions=max(1, min(plan.shards, -(-plan.slots // 100_000))))
    return ids.mapInPandas(fill, "out_shard int, slot long, source_no int, block long, pass int").hint("merge")


def place_documents(docs: DataFrame, plan: MixPlan, source_col: str, id_col: str, size_col: str, tie: list) -> DataFrame:
    """``docs`` with source_no and ``start``, the words of the source before the document.

    Documents of a source follow by a hash of their id, then the id, then ``tie``.
    """
    spark = docs.sparkSession
    names = spark.createDataFrame([(s.number, s.name) for s in plan.sources], "source_no int, __name string")
    # One short row per source; beyond this many the join is left to the planner.
    names = F.broadcast(names) if len(plan.sources) <= 10_000 else names
    numbered = docs.join(names, docs[source_col].eqNullSafe(names["__name"])).drop("__name")
    numbered = numbered.withColumn("__chunk", F.pmod(F.xxhash64(id_col), F.lit(CHUNKS)).cast("int"))
    return with_offsets(numbered, "source_no", "__chunk", [F.col(id_col).asc_nulls_first(), *tie], size_col, "start").drop("__chunk")


def with_spans(placed: DataFrame, plan: MixPlan, size_col: str) -> DataFrame:
    """A row for every block that a document has words in: + block, first_word (in the document) and
    n_words.  Documents without words have none."""
    b = plan.block_words
    end = F.col("start") + F.col(size_col)
    spans = placed.where(F.col(size_col) > 0).withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / b), F.floor((end - 1) / b))))
    low = F.greatest(F.col("start"), F.col("block") * b)
    return spans.withColumn("first_word", low - F.col("start")).withColumn("n_words", F.least(end, (F.col("block") + 1) * b) - low)


def word_count(text: str) -> F.Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_REGEX)), F.lit(0)).cast("long")


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """The mix as rows of documents: one for every piece of a document in a slot's block.

    Columns of ``docs`` (text: the words of the piece as they stand in the document, with the white
    space between them) and out_shard, slot, pass, which get underscores behind their names where
    ``docs`` has these.  Pieces of one slot make up its block in the order
    of source.start.  Null texts have no words and thus no piece; a null source is a source of its own.
    Repeated rows are documents of their own.  Reruns agree.
    """
    small_batches(docs.sparkSession)
    # The other columns of docs travel as one, so that their names meet no other.
    row = F.struct(*[docs[c] for c in docs.columns if c != text_col]).alias("row")
    slim = docs.select(row, docs[id_col].alias("id"), docs[source_col].alias("src"), docs[text_col].alias("text")).withColumn("size", word_count("text"))
    plan = plan_mix(slim.select("src", "size"), "src", "size", block_words, seed=seed)
    placed = place_documents(slim, plan, "src", "id", "size", [F.xxhash64("text")])
    mixed = slot_table(docs.sparkSession, plan).join(_cut(placed, plan), ["source_no", "block"])
    columns = [F.col("text") if c == text_col else F.col("row")[c].alias(c) for c in docs.columns]
    return mixed.select(*[c.alias(n) for c, n in zip(columns, docs.columns, strict=True)], *[F.col(c).alias(unused(c, docs.columns)) for c in ("out_shard", "slot", "pass")])


def _cut(placed: DataFrame, plan: MixPlan) -> DataFrame:
    """Rows (row, source_no, text, block): the documents cut at the borders of blocks."""
    word, b = re.compile(f"[^{WHITE_SPACE}]+"), plan.block_words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 256):
                batch = whole.slice(first, 256)
                rows, texts, blocks = [], [], []
                for row, (text, start, size) in enumerate(zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)), strict=True)):
                    if not size:
                        continue
                    from_char, seen, end = 0, start, None
                    for match in word.finditer(text):
                        if end is not None and seen % b == 0:
                            rows.append(row), texts.append(text[from_char:end]), blocks.append((seen - 1) // b)
                            from_char = match.start()
                        elif end is None:
                            from_char = match.start()
                        end, seen = match.end(), seen + 1
                    rows.append(row), texts.append(text[from_char:end]), blocks.append((seen - 1) // b)
                taken = batch.take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([taken.column(0), taken.column(1), pa.array(texts, pa.string()), pa.array(blocks, pa.int64())], names=["row", "source_no", "text", "block"])

    slim = placed.select("row", "source_no", "text", "start", "size")
    return slim.mapInArrow(run, StructType([*slim.schema.fields[:3], StructField("block", LongType())]))


def mix_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """How many words the mix takes of every document.

    Rows (id, size, source_size, target, taken): ``taken`` adds up the words of the document in the
    blocks of all slots.  Documents without words are listed with 0.  Repeated rows are documents of
    their own; null ids and sources are carried.
    """
    slim = materialize(docs.select(docs[id_col].alias("id"), docs[source_col].alias("src"), word_count(text_col).alias("size"), F.xxhash64(text_col).alias("tie")), "mix-sizes")
    plan = plan_mix(slim, "src", "size", block_words, seed=seed)
    placed = materialize(place_documents(slim, plan, "src", "id", "size", [F.col("tie")]), "mix-placed")
    pieces = with_spans(placed, plan, "size").select("id", "source_no", "start", "size", "block", "n_words")
    mixed = slot_table(docs.sparkSession, plan).join(pieces, ["source_no", "block"]).select("id", "source_no", "start", "size", F.col("n_words").alias("taken"))
    # source_no and start tell documents with words apart.
    with_words = placed.where("size > 0").select("id", "source_no", "start", "size", F.lit(0).cast("long").alias("taken"))
    taken = with_words.union(mixed).groupBy("id", "source_no", "start", "size").agg(F.sum("taken").alias("taken"))
    rows = taken.select("id", "size", "source_no", "taken").union(placed.where("size = 0").select("id", "size", "source_no", F.lit(0).cast("long")))
    sources = docs.sparkSession.createDataFrame([(s.number, s.size, s.target) for s in plan.sources], "source_no int, source_size long, target double")
    sources = F.broadcast(sources) if len(plan.sources) <= 10_000 else sources
    return rows.join(sources, "source_no").select(F.col("id").alias(id_col), "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all ``documents``; see ``mix_report``."""
    return mix_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
