"""Extraction: a pluggable extractor, and its JSON output as rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

# What an answer may hold.
MANUFACTURERS = ("nvidia", "amd", "intel", "google", "apple", "huawei", "graphcore", "cerebras", "amazon", "other", "unknown")
SUBTYPES = ("datacenter-gpu", "consumer-gpu", "workstation-gpu", "mobile-gpu", "tpu", "fpga", "npu-asic", "manycore", "generic-gpu", "generic-accelerator", "not-an-accelerator")
CONTEXTS = ("used-in-this-work", "comparison-or-related-work", "object-of-study", "speculative-future")
BASES = ("explicit", "inferred")
USED = CONTEXTS[0]
INT32 = 2147483647

ANSWER = "struct<mentions:array<map<string,string>>,_broken:string>"
#: Fields of a mention: the type of its column, whether it may be null, and the values that it may have.
FIELDS = {
    "model_raw": ("string", False, None),
    "model_normalized": ("string", True, None),
    "manufacturer": ("string", False, MANUFACTURERS),
    "accelerator_subtype": ("string", False, SUBTYPES),
    "device_count": ("decimal(38,0)", True, None),
    "device_count_basis": ("string", True, BASES),
    "memory_gb": ("double", True, None),
    "usage_context": ("string", False, CONTEXTS),
    "evidence_quote": ("string", False, None),
}


def _valid(mention: Column) -> Column:
    """Whether a mention (a map) has every field, of its type and among its values; more fields may follow."""
    out = mention.isNotNull()
    for name, (kind, nullable, values) in FIELDS.items():
        value = F.try_element_at(mention, F.lit(name))
        good = F.lit(True)
        if values:
            good = value.isin(*values)
        elif kind == "double":
            good = value.try_cast("double").isNotNull()
        elif kind != "string":
            good = value.rlike(r"^[+-]?\d+(\.0*)?$")
        out = out & F.map_contains_key(mention, F.lit(name)) & F.when(value.isNull(), F.lit(nullable)).otherwise(good)
    return F.coalesce(out, F.lit(False))


def parse_answers(df: DataFrame, raw: str, truncated: str) -> DataFrame:
    """``df`` with status and mentions (array of structs of the fields).

    A truncated answer is ``truncated``; text that is no JSON object with a list of valid mentions is
    ``json_error``; an empty list is ``no_mention``; else the answer is ``ok``.
    """
    parsed = F.from_json(F.col(raw), ANSWER, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    out = df.withColumn("__a", parsed)
    bad = F.col(raw).isNull() | F.col("__a._broken").isNotNull() | F.col("__a.mentions").isNull() | F.exists("__a.mentions", lambda m: ~_valid(m))
    status = F.when(F.col(truncated), "truncated").when(bad, "json_error").when(F.size("__a.mentions") == 0, "no_mention").otherwise("ok")
    # A count of more digits than a decimal has is one at its end.
    count = lambda v: F.coalesce(v.try_cast("decimal(38,0)"), F.when(v.rlike(r"^\+?\d"), F.lit(INT32 + 1)).when(v.isNotNull(), F.lit(-INT32 - 1)).cast("decimal(38,0)"))
    typed = lambda m: F.struct(*[(count(F.try_element_at(m, F.lit(n))) if k.startswith("decimal") else F.try_element_at(m, F.lit(n)).try_cast(k)).alias(n) for n, (k, _, _) in FIELDS.items()])
    return out.withColumn("status", status).withColumn("mentions", F.when(F.col("status") == "ok", F.transform("__a.mentions", typed))).drop("__a")


def clamp_int32(value: Column) -> Column:
    """Integers of any size as Int32: above the range its end, below it 0."""
    big = value.try_cast("decimal(38,0)")
    return F.when(big > INT32, F.lit(INT32)).when(big < -INT32, F.lit(0)).otherwise(big).cast("int")


def mention_rows(answers: DataFrame, key: str, *keep: str) -> DataFrame:
    """One row per mention, or one with nulls for an answer without any; with the columns ``keep``."""
    rows = answers.select(key, *keep, "status", F.posexplode_outer("mentions").alias("mention_idx", "m"))
    return rows.select(key, *keep, "status", "mention_idx", *[clamp_int32(F.col("m.device_count")).alias(n) if n == "device_count" else F.col(f"m.{n}") for n in FIELDS])


def extract(passages: DataFrame, key: str, prompt: str, load: Callable[[], Callable[[list[str]], list[tuple[str, bool]]]]) -> DataFrame:
    """(key, raw_json, truncated): a generator over batches of prompts, loaded once per task.

    ``load`` runs on the executor and returns the generator, which maps prompts to (answer, truncated).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        generate = None
        for batch in batches:
            generate = generate or load()
            answers = generate(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a for a, _ in answers], pa.string()), pa.array([t for _, t in answers], pa.bool_())], names=[key, "raw_json", "truncated"])

    kind = passages.schema[key].dataType.simpleString()
    return passages.select(key, prompt).mapInArrow(run, f"{key} {kind}, raw_json string, truncated boolean")


def rule_extractor(pattern: str) -> Callable[[], Callable[[list[str]], list[tuple[str, bool]]]]:
    """A deterministic stand-in for a model: mentions are the matches of ``pattern``, with a number
    right before them as device count."""

    def load():
        import json
        import re

        find = re.compile(rf"(?:(\d+)\s+(?:x\s+)?)?({pattern})")

        def generate(prompts: list[str]) -> list[tuple[str, bool]]:
            out = []
            for text in prompts:
                fixed = {"model_normalized": None, "manufacturer": "unknown", "accelerator_subtype": "generic-accelerator", "memory_gb": None, "usage_context": USED}
                found = [fixed | {"model_raw": m[2], "device_count": int(m[1]) if m[1] else None, "device_count_basis": "explicit" if m[1] else None, "evidence_quote": m[0]} for m in find.finditer(text or "")]
                out.append((json.dumps({"mentions": found}), False))
            return out

        return generate

    return load
