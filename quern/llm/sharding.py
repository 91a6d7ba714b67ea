"""Sharding by jump consistent hashing, in SQL expressions only.

A key walks over shard numbers by the jumps of a linear congruential generator seeded with it; the
last number below the shard count is its shard.  There is no ring or other table, and with one more
shard a key either stays or moves into the new one.  Keys and the shard count alone decide, so equal
texts of different keys need not meet in a shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quern.llm.numbering import CHUNKS, with_offsets
from quern.llm.storage import new_folder, unused

#: Multiplier of the generator of jump consistent hashing (Lamping and Veach).
MULTIPLIER = 2862933555777941757
#: 64-bit products are made of limbs of 22, 22 and 20 bits, whose sums never overflow a long.
LIMB = (1 << 22) - 1
SHARDS = 40


def _limbs(key: Column) -> list[Column]:
    return [key.bitwiseAND(F.lit(LIMB)), F.shiftrightunsigned(key, 22).bitwiseAND(F.lit(LIMB)), F.shiftrightunsigned(key, 44)]


def _next_limbs(k: list[Column]) -> list[Column]:
    """Limbs of key * MULTIPLIER + 1 modulo 2**64."""
    a = [MULTIPLIER & LIMB, MULTIPLIER >> 22 & LIMB, MULTIPLIER >> 44]
    low = k[0] * a[0] + 1
    middle = k[0] * a[1] + k[1] * a[0] + F.shiftright(low, 22)
    high = k[0] * a[2] + k[1] * a[1] + k[2] * a[0] + F.shiftright(middle, 22)
    return [low.bitwiseAND(F.lit(LIMB)), middle.bitwiseAND(F.lit(LIMB)), high.bitwiseAND(F.lit((1 << 20) - 1))]


def _top31(k: list[Column]) -> Column:
    """The upper 31 of the 64 bits."""
    return F.shiftright(k[1], 11).bitwiseOR(F.shiftleft(k[2], 11))


def jump_shards(key: Column, shards: int) -> Column:
    """Struct (shard, grown_shard) of a long key: its shard among ``shards``, and among one more."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    first = _limbs(key)
    long = lambda x: F.lit(x).cast("long")
    start = F.struct(*(x.alias(f"k{i}") for i, x in enumerate(first)), long(0).alias("b"), long(0).alias("grown"), long(0).alias("j"))

    def step(state: Column, _: Column) -> Column:
        k = _next_limbs([state["k0"], state["k1"], state["k2"]])
        at = state["j"]
        jump = F.floor((at + 1).cast("double") * (F.lit(float(1 << 31)) / (_top31(k) + 1).cast("double"))).cast("long")
        moved = F.struct(*(x.alias(f"k{i}") for i, x in enumerate(k)), F.when(at < shards, at).otherwise(state["b"]).alias("b"), at.alias("grown"), jump.alias("j"))
        return F.when(at <= shards, moved).otherwise(state)

    # Every jump goes up by one at least, so this many steps pass all shards.
    done = F.aggregate(F.sequence(F.lit(0), F.lit(shards)), start, step)
    return F.struct(done["b"].cast("int").alias("shard"), done["grown"].cast("int").alias("grown_shard"))


def assign_shards(df: DataFrame, key_col: str, shards: int = SHARDS, size: Column | None = None) -> DataFrame:
    """``df`` with columns shard, grown_shard and slot (gapless from 0 in every shard), which get
    underscores behind their names where ``df`` has these.

    The key is a long; a null key counts as 0.  Slots follow a hash of the key, then the key, then
    ``size``; rows that tie get neighbouring slots.  Repeated rows share a shard.  An empty table stays
    empty.
    """
    # The columns of df travel as one, so that their names meet no other.
    slim = df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), df[key_col].alias("key"), (F.lit(0) if size is None else size).alias("order"))
    key = F.coalesce(F.col("key").cast("long"), F.lit(0).cast("long"))
    placed = slim.withColumn("to", jump_shards(key, shards)).select("row", "key", "order", "to.shard", "to.grown_shard")
    placed = placed.withColumn("chunk", (_top31(_next_limbs(_limbs(key))) % CHUNKS).cast("int")).withColumn("one", F.lit(1).cast("long"))
    out = with_offsets(placed, "shard", "chunk", [F.col("key").asc_nulls_first(), F.col("order")], "one", "slot")
    return out.select("row.*", *[F.col(c).alias(unused(c, df.columns)) for c in ("shard", "grown_shard", "slot")])


def write_shards(df: DataFrame, key_col: str, path: str | None = None, shards: int = SHARDS) -> str:
    """Write ``df`` as one Parquet folder per shard and return the path (a new shared folder if none
    is given).  Rows are dealt by shard and a part of their key, so that no shard is one task's."""
    path, shard = path or new_folder(df.sparkSession, "shards"), unused("shard", df.columns)
    key = F.coalesce(F.col(key_col).cast("long"), F.lit(0).cast("long"))
    out = df.withColumn(shard, jump_shards(key, shards)["shard"])
    out.repartition(shard, F.pmod(F.xxhash64(key_col), F.lit(8))).write.partitionBy(shard).parquet(path)
    return path


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in shards 0 to 39 under law ``key``.

    size is the UTF-8 bytes of the text plus 16, text_crc32 that of those bytes; a null text has none.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"))
    return assign_shards(slim, "doc_id", SHARDS, F.struct("size", "text_crc32"))


def _crc_table() -> list[int]:
    """The 256 remainders of CRC-32, for the SQL twin: DuckDB has no such function."""
    table = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        table.append(value)
    return table


_CRC_TABLE = _crc_table()

OP1_SQL = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 16 AS BIGINT) AS size,
         CAST(coalesce(doc_id, 0) AS HUGEINT) AS key0, hex(encode(coalesce(text, ''))) AS hx
  FROM documents),
w AS (
  SELECT rid, CAST((key0 + 18446744073709551616) % 18446744073709551616 AS UHUGEINT) AS key, CAST(0 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS j, 0 AS n FROM d
  UNION ALL
  SELECT rid, key2, j, CAST(floor((j + 1)::DOUBLE * (2147483648.0::DOUBLE / ((key2 >> 33) + 1)::DOUBLE)) AS BIGINT), n + 1
  FROM (SELECT rid, j, n, (key * {MULTIPLIER}::UHUGEINT + 1::UHUGEINT) % 18446744073709551616::UHUGEINT AS key2 FROM w WHERE j <= {SHARDS})),
s AS (
  SELECT rid, CAST(max(pos) FILTER (WHERE pos < {SHARDS}) AS INTEGER) AS shard, CAST(max(pos) AS INTEGER) AS grown_shard,
         CAST((max(key) FILTER (WHERE n = 1) >> 33) % {CHUNKS} AS INTEGER) AS chunk
  FROM w WHERE n > 0 GROUP BY rid),
c AS (
  SELECT rid, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(hx) // 2), lambda i: ('0x' || hx[2 * i + 1:2 * i + 2])::BIGINT)),
         lambda a, b: xor(a >> 8, ({_CRC_TABLE})[xor(a & 255, b) + 1])), 4294967295) AS text_crc32
  FROM d)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, CAST(row_number() OVER (PARTITION BY shard ORDER BY chunk, doc_id NULLS FIRST, size, text_crc32) - 1 AS BIGINT) AS slot, grown_shard
FROM d JOIN s USING (rid) JOIN c USING (rid)
"""
