"""Chat formatting: tool calls linked to their results.

Messages become calls and results with identifiers.  Results are joined to calls by identifier, calls
are put in topological order of what they depend on, arguments are checked against the schema of the
tool, and every call is serialised as canonical JSON.

A message whose text is a JSON object with ``tool_calls`` (a list of objects with id, name, arguments
and, at will, depends_on: a list of ids) holds those calls; one with ``tool_call_id`` and ``content``
is a result.  Every other message is plain chat and maps to the tool ``chat.turn``: a message of a user
or of the system is a call under the identifier of its turn, that depends on the call two turns before
it; any other message is the result of the turn before it.  Identifiers hold within a conversation.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quern.llm.storage import materialize, new_folder

#: Arguments of a plain message.
CHAT_SCHEMA = {
    "type": "object",
    "required": ["role", "text", "turn"],
    "additionalProperties": False,
    "properties": {"role": {"enum": ["system", "user"]}, "text": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}},
}
SCHEMAS = {"chat.turn": CHAT_SCHEMA}

_TYPES = {
    "object": lambda v: isinstance(v, dict),
    "array": lambda v: isinstance(v, list),
    "string": lambda v: isinstance(v, str),
    "boolean": lambda v: isinstance(v, bool),
    "null": lambda v: v is None,
    "integer": lambda v: isinstance(v, int) and not isinstance(v, bool) or isinstance(v, float) and v.is_integer(),
    "number": lambda v: isinstance(v, int | float) and not isinstance(v, bool),
}


#: Keywords that ``violations`` checks, and those that say nothing about a value.
CHECKED = frozenset(["type", "enum", "const", "minLength", "maxLength", "minimum", "maximum", "required", "properties", "additionalProperties", "items", "minItems", "maxItems"])
REMARKS = frozenset(["$schema", "$id", "$comment", "title", "description", "default", "examples"])
#: JSON that is nested deeper is no call or result: nothing here recurses further.
MOST_DEPTH = 100


def require_known(schema: dict, at: str = "$") -> None:
    """Raise ValueError for a keyword that ``violations`` could not check."""
    unknown = sorted(set(schema) - CHECKED - REMARKS)
    if unknown or not isinstance(schema.get("additionalProperties", True), bool):
        raise ValueError(f"{at}: cannot check {', '.join(unknown) or 'additionalProperties as a schema'}")
    for name, inner in schema.get("properties", {}).items():
        require_known(inner, f"{at}.{name}")
    if "items" in schema:
        require_known(schema["items"], f"{at}[]")


def _same(a, b) -> bool:
    """Equality of JSON values: true and false are no numbers."""
    return type(a) is type(b) and a == b if isinstance(a, bool) or isinstance(b, bool) else a == b


def violations(value, schema: dict, at: str = "$") -> list[str]:
    """What keeps ``value`` from the schema: 'place: keyword', in a fixed order."""
    out = []
    kinds = schema.get("type")
    if kinds is not None and not any(_TYPES[k](value) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return [f"{at}: type"]
    if "enum" in schema and not any(_same(value, x) for x in schema["enum"]):
        out.append(f"{at}: enum")
    if "const" in schema and not _same(value, schema["const"]):
        out.append(f"{at}: const")
    for kind, least, most in ((str, "minLength", "maxLength"), (list, "minItems", "maxItems")):
        if isinstance(value, kind):
            out += [f"{at}: {least}"] * (len(value) < schema.get(least, 0)) + [f"{at}: {most}"] * (len(value) > schema.get(most, math.inf))
    if isinstance(value, int | float) and not isinstance(value, bool):
        if value < schema.get("minimum", -math.inf):
            out.append(f"{at}: minimum")
        if value > schema.get("maximum", math.inf):
            out.append(f"{at}: maximum")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: required" for k in sorted(schema.get("required", ())) if k not in value]
        if schema.get("additionalProperties") is False:
            out += [f"{at}.{k}: additionalProperties" for k in sorted(value) if k not in known]
        for k in sorted(known):
            if k in value:
                out += violations(value[k], known[k], f"{at}.{k}")
    if isinstance(value, list) and "items" in schema:
        for k, item in enumerate(value):
            out += violations(item, schema["items"], f"{at}[{k}]")
    return out


def storable(text: str) -> str:
    """``text`` with lone surrogates, which UTF-8 does not have, as \\u escapes: in JSON the same string."""
    return text if text.isascii() else re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", text)


def canonical(value) -> str:
    """JSON with sorted keys, no spaces, whole floats as integers and no non-finite numbers."""

    def plain(v):
        if isinstance(v, dict):
            return {str(k): plain(x) for k, x in v.items()}
        if isinstance(v, list | tuple):
            return [plain(x) for x in v]
        if isinstance(v, float):
            if not math.isfinite(v):
                return None
            return int(v) if v.is_integer() and abs(v) < 1 << 53 else v
        return v

    return storable(json.dumps(plain(value), ensure_ascii=False, sort_keys=True, separators=(",", ":")))


def _depth(value) -> int:
    depth, layer = 0, [value]
    while layer:
        depth += 1
        layer = [x for v in layer if isinstance(v, dict | list) for x in (v.values() if isinstance(v, dict) else v)]
    return depth


def read_message(turn: int | None, role: str | None, text: str | None) -> list[tuple]:
    """Events of a message: ('call', id, name, arguments JSON, depends_on) or ('result', id, None, content JSON, [])."""
    if text and text.lstrip()[:1] == "{":
        try:
            found = json.loads(text)
        except (ValueError, RecursionError):
            found = None
        if isinstance(found, dict) and _depth(found) > MOST_DEPTH:
            found = None
        if isinstance(found, dict) and isinstance(found.get("tool_calls"), list):
            calls = [c for c in found["tool_calls"] if isinstance(c, dict) and c.get("id") is not None]
            return [("call", _name(c["id"]), _name(c.get("name")), json.dumps(c.get("arguments")), [_name(x) for x in c["depends_on"]] if isinstance(c.get("depends_on"), list) else []) for c in calls]
        if isinstance(found, dict) and found.get("tool_call_id") is not None:
            return [("result", _name(found["tool_call_id"]), None, json.dumps(found.get("content")), [])]
    if role in ("user", "system"):
        arguments = {"role": role, "text": text, "turn": turn}
        return [("call", f"turn-{turn}", "chat.turn", json.dumps(arguments), [] if turn is None else [f"turn-{turn - 2}"])]
    before = "none" if turn is None else turn - 1
    return [("result", f"turn-{before}", None, json.dumps({"role": role, "text": text}), [])]


def _name(value) -> str:
    return storable(str(value))


def read_events(messages: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Rows (conv, turn, kind, call_id, name, body, depends_on) of all messages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, out = [], []
            for k, (turn, role, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True)):
                for event in read_message(turn, role, text):
                    row.append(k), out.append(event)
            if row:
                kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string())]
                taken = batch.take(pa.array(row))
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([taken.column(0), taken.column(1), *columns], names=["conv", "turn", "kind", "call_id", "name", "body", "depends_on"])

    key = messages.schema[conv_col].dataType.simpleString()
    slim = messages.select(messages[conv_col].alias("conv"), messages[turn_col].cast("long").alias("turn"), messages[role_col].cast("string").alias("role"), messages[text_col].cast("string").alias("text"))
    return slim.mapInArrow(run, f"conv {key}, turn long, kind string, call_id string, name string, body string, depends_on array<string>")


def call_levels(calls: DataFrame) -> DataFrame:
    """(conv, call_id, level) of calls (conv, call_id, depends_on): 0 without a known dependency, else
    one more than the highest of them; null on a cycle or behind one.

    Chains of calls with one dependency each are contracted by pointer doubling: in every round a call
    takes over the target of its target, until that is an *anchor*, a call with no dependency or with
    several.  A chain of n calls takes log2(n) rounds.  Only anchors with several dependencies are then
    placed one level of them after the other.
    """
    spark = calls.sparkSession
    call, on = ["conv", "call_id"], ["conv", "on"]
    waits = calls.select(*call, F.explode("depends_on").alias("on")).distinct()
    known = materialize(calls.select(*call).distinct(), "tool-known")
    edges = materialize(waits.join(known.withColumnRenamed("call_id", "on"), on, "left_semi"), "tool-edges")
    degree = edges.groupBy(*call).agg(F.count("*").alias("n"), F.min("on").alias("on"))
    placed = known.join(degree, call, "left")
    single = F.coalesce(F.col("n") == 1, F.lit(False))
    step = placed.select(*call, F.when(single, F.col("on")).otherwise(F.col("call_id")).alias("on"), single.cast("int").alias("dist"), (~single).alias("done"))
    step = materialize(step, "tool-steps")
    waiting = step.where("not done").count()
    while waiting:
        target = step.select("conv", F.col("call_id").alias("on"), F.col("on").alias("next"), F.col("dist").alias("more"), F.col("done").alias("reached"))
        jumped = step.where("not done").join(target, on).select(*call, F.col("next").alias("on"), (F.col("dist") + F.col("more")).alias("dist"), F.col("reached").alias("done"))
        step = materialize(step.where("done").union(jumped), "tool-steps")
        left = step.where("not done").count()
        if left == waiting:  # what no round brings to an anchor is on a cycle of single dependencies or behind one
            break
        waiting = left
    step = step.where("done")
    # Levels of the anchors, one file per round in one folder.
    folder = new_folder(spark, "tool-levels")
    placed.where("n is null").select(*call, F.lit(0).alias("level")).write.parquet(folder)
    levels = spark.read.schema(f"conv {known.schema['conv'].dataType.simpleString()}, call_id string, level int")
    joins = materialize(edges.join(degree.where("n > 1").select(*call), call).join(step.select("conv", F.col("call_id").alias("on"), F.col("on").alias("anchor"), "dist"), on, "left").select(*call, "anchor", "dist"), "tool-joins")
    while not joins.isEmpty():
        known_levels = levels.parquet(folder).select("conv", F.col("call_id").alias("anchor"), "level")
        # A call is ready when all of its anchors are placed; one on a cycle never is.
        ready = joins.join(known_levels, ["conv", "anchor"], "left").groupBy(*call).agg(F.max(F.col("level") + F.col("dist") + 1).alias("level"), F.count_if(F.col("level").isNull()).alias("open")).where("open = 0").select(*call, F.col("level").cast("int").alias("level"))
        ready = materialize(ready, "tool-ready")
        if ready.isEmpty():
            break
        ready.write.mode("append").parquet(folder)
        joins = materialize(joins.join(ready, call, "left_anti"), "tool-joins")
    reached = step.join(levels.parquet(folder).select("conv", F.col("call_id").alias("on"), F.col("level").alias("above")), on).select(*call, (F.col("above") + F.col("dist")).cast("int").alias("level"))
    return known.join(reached, call, "left")


def link_calls(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", schemas: dict[str, dict] = SCHEMAS) -> DataFrame:
    """One row per call and result of it: (conv, turn, call_id, level, result_turn, linked, valid,
    errors, json).

    A call without a result and a result without a call have a row with ``linked`` false (the latter
    with null turn, level and valid).  Ordering by (conv, level, turn, call_id) is topological.
    ``errors`` lists schema violations, joined by '; '; a tool without schema gives 'unknown tool'.
    Null conversations never link; a null turn is carried; repeated messages give repeated rows, each
    with each of the results that share its identifier.  JSON nested deeper than 100 is plain chat, and
    lone surrogates stay escaped.  A schema with a keyword that cannot be checked raises ValueError.
    """
    for schema in schemas.values():
        require_known(schema)
    events = materialize(read_events(messages, conv_col, turn_col, role_col, text_col), "tool-events")
    calls = events.where("kind = 'call'")
    levels = call_levels(calls.where("conv is not null"))
    calls = calls.join(levels, ["conv", "call_id"], "left").select("conv", "call_id", "turn", "name", "body", "depends_on", F.when(F.col("conv").isNull(), 0).otherwise(F.col("level")).alias("level"))
    results = events.where("kind = 'result'").select("conv", "call_id", F.col("turn").alias("result_turn"), F.col("body").alias("result"))
    both = calls.join(results.hint("shuffle_hash"), ["conv", "call_id"], "full")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(n).to_pylist() for n in ("call_id", "name", "body", "depends_on", "result")), strict=True)
            valid, errors, text = [], [], []
            for call_id, name, body, depends_on, result in rows:
                out = {"id": call_id}
                if body is None:
                    valid.append(None), errors.append(None)
                else:
                    arguments = json.loads(body)
                    schema = schemas.get(name)
                    found = ["unknown tool"] if schema is None else violations(arguments, schema)
                    valid.append(not found), errors.append("; ".join(found))
                    out |= {"name": name, "arguments": arguments, "depends_on": depends_on}
                if result is not None:
                    out["result"] = json.loads(result)
                text.append(canonical(out))
            keep = [batch.column(n) for n in ("conv", "turn", "call_id", "level", "result_turn", "linked")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(valid, pa.bool_()), pa.array(errors, pa.string()), pa.array(text, pa.string())], names=["conv", "turn", "call_id", "level", "result_turn", "linked", "valid", "errors", "json"])

    linked: Column = F.col("body").isNotNull() & F.col("result").isNotNull()
    key = messages.schema[conv_col].dataType.simpleString()
    schema = f"conv {key}, turn long, call_id string, level int, result_turn long, linked boolean, valid boolean, errors string, json string"
    return both.withColumn("linked", linked).mapInArrow(run, schema).withColumnRenamed("conv", conv_col)


def op7_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``conversations`` as linked calls; see ``link_calls``."""
    return link_calls(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP7_SQL = """
WITH RECURSIVE c AS (SELECT conv_id, turn, role, text, 'turn-' || turn AS call_id FROM conversations WHERE role IN ('user', 'system')),
r AS (SELECT conv_id, turn, 'turn-' || (turn - 1) AS call_id, json_object('role', role, 'text', text) AS result FROM conversations WHERE role NOT IN ('user', 'system')),
l AS (
  SELECT c.conv_id, c.turn, 0 AS level FROM c WHERE NOT EXISTS (SELECT 1 FROM c d WHERE d.conv_id = c.conv_id AND d.turn = c.turn - 2)
  UNION ALL SELECT c.conv_id, c.turn, l.level + 1 FROM l JOIN c ON c.conv_id = l.conv_id AND c.turn = l.turn + 2)
SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, c.turn, coalesce(c.call_id, r.call_id) AS call_id, l.level, r.turn AS result_turn,
       c.call_id IS NOT NULL AND r.call_id IS NOT NULL AS linked,
       CASE WHEN c.call_id IS NOT NULL THEN length(c.text) > 0 AND c.turn >= 0 END AS valid,
       CASE WHEN c.call_id IS NOT NULL THEN CASE WHEN length(c.text) = 0 THEN '$.text: minLength' ELSE '' END END AS errors,
       CASE WHEN c.call_id IS NULL THEN '{"id":"' || r.call_id || '","result":' || r.result || '}'
            ELSE '{"arguments":' || json_object('role', c.role, 'text', c.text, 'turn', c.turn) || ',"depends_on":["turn-' || (c.turn - 2) || '"],"id":"' || c.call_id || '","name":"chat.turn"'
                 || CASE WHEN r.result IS NULL THEN '' ELSE ',"result":' || r.result END || '}' END AS json
FROM c FULL JOIN r ON c.conv_id = r.conv_id AND c.call_id = r.call_id LEFT JOIN l ON l.conv_id = c.conv_id AND l.turn = c.turn
"""
