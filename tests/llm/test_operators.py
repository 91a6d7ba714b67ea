"""The ten operators against brute force on small tables, with nulls, ties, repeats and empty tables."""

from __future__ import annotations

import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.llm import byte_bpe, embedding_dedup, graph, line_dedup, mixing, quality, repair, sharding, simhash, token_files, tool_calls, warc

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, id int, size string, tie int, key string, shard string, slot int, start int, block string, ranges int, row string, grown_shard int, __deleted string, node int, fp string"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def table(spark, texts, sources=("a", "b", None)):
    """Documents with ids from 0 and extra columns whose names clash with those used inside."""
    rows = [(k, t, "en", sources[k % len(sources)], len(t or ""), 9, "s", 1, "k", "x", 3, 4, "b", 5, "r", 6, "d", 7, "f") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def groups_of(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# ---- components -------------------------------------------------------------------------------


def test_components(spark):
    rng = random.Random(5)
    pairs = [(k, k + 1) for k in range(0, 40)] + [(100 + rng.randrange(60), 100 + rng.randrange(60)) for _ in range(50)] + [(200, 200), (7, None)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(pairs, "a bigint, b bigint"), "a", "b").collect()}
    real = [p for p in pairs if None not in p and p[0] != p[1]]
    assert got == groups_of(real, {n for p in real for n in p})
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0


# ---- 1 sharding -------------------------------------------------------------------------------


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash(spark):
    keys = [0, 1, 2, 10**12, -1, -(2**63), 2**63 - 1, *range(1000, 1200)]
    frame = spark.createDataFrame([(k,) for k in keys], "k bigint").select("k", sharding.jump_shards(F.col("k"), 40).alias("s"))
    for r in frame.collect():
        assert (r["s"]["shard"], r["s"]["grown_shard"]) == (jump(r["k"] % (1 << 64), 40), jump(r["k"] % (1 << 64), 41))


def test_slots_are_gapless(spark):
    rows = [(k,) for k in [None, None, 5, 5, *range(500)]]
    got = sharding.assign_shards(spark.createDataFrame(rows, "doc_id bigint"), "doc_id", 7).collect()
    assert len(got) == len(rows)
    for shard in range(7):
        slots = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert sharding.assign_shards(spark.createDataFrame([], "doc_id bigint"), "doc_id", 7).count() == 0
    clash = sharding.assign_shards(table(spark, ["a", None]), "doc_id", 7)
    assert clash.columns[-3:] == ["shard_", "grown_shard_", "slot_"] and [r["shard"] for r in clash.collect()] == ["x", "x"]
    folder = sharding.write_shards(table(spark, ["a", None]), "doc_id")
    assert spark.read.parquet(folder).where("shard = 'x'").count() == 2


# ---- 2 mixing ---------------------------------------------------------------------------------


def test_targets():
    assert mixing.share_targets([100, 100, 100]) == [pytest.approx(300 * 5 / 8), pytest.approx(75), pytest.approx(300 / 8)]
    capped = mixing.share_targets([1, 1000, 1000])
    assert capped[0] == 3 and sum(capped) == pytest.approx(2001) and capped[1] == pytest.approx(2 * capped[2])
    assert mixing.share_targets([0, 0]) == [0, 0] and mixing.share_targets([]) == []


@given(n=st.integers(1, 500), seed=st.integers(0, 10**6))
@settings(max_examples=40, deadline=None)
def test_permutation(n, seed):
    assert sorted(mixing.permuted(np.arange(n), n, seed).tolist()) == list(range(n))


def test_shard_draws_add_up():
    plan = mixing.MixPlan(tuple(mixing.Source(k, str(k), 0, 0.0, 10, n) for k, n in enumerate((700, 300, 45))), 8, 64, 1)
    drawn = list(mixing.shard_counts(plan, 0, plan.shards))
    assert sum(c.sum() for *_, c in drawn) == 1045 and all(c.sum() == 64 for *_, c in drawn[:-1])
    total = np.zeros(3, int)
    for _, slot, before, counts in drawn:
        assert (before == total).all() and slot == total.sum()
        total += counts
    alone = next(iter(mixing.shard_counts(plan, 5, 6)))
    assert (alone[3] == drawn[5][3]).all()


def test_parts_of_a_large_mix(monkeypatch):
    monkeypatch.setattr(mixing, "SLOTS_PER_PART", 200)
    plan = mixing.MixPlan(tuple(mixing.Source(k, str(k), 0, 0.0, 10, n) for k, n in enumerate((700, 300, 45))), 8, 64, 1)
    drawn, total = list(mixing.shard_counts(plan, 0, plan.shards)), np.zeros(3, int)
    assert [d[0] for d in drawn] == list(range(plan.shards))
    for _, slot, before, counts in drawn:
        assert (before == total).all() and slot == total.sum() and counts.sum() <= 64
        total += counts
    assert total.tolist() == [700, 300, 45]


def test_mix(spark):
    rng = random.Random(1)
    docs = table(spark, [words(rng, rng.randint(1, 300)) for _ in range(200)] + [None, "", "  "])
    report = mixing.mix_report(docs, block_words=16)
    got = {r["doc_id"]: r for r in report.collect()}
    assert len(got) == 203 and all(r["taken"] <= 3 * r["size"] for r in got.values())
    of = {r["doc_id"]: r["source"] for r in docs.collect()}
    for source in ("a", "b", None):
        mine = [r for k, r in got.items() if of[k] == source]
        assert sum(r["taken"] for r in mine) == pytest.approx(mine[0]["target"], abs=40)
        assert sum(r["size"] for r in mine) == mine[0]["source_size"]
    assert {k: r["taken"] for k, r in got.items()} == {r["doc_id"]: r["taken"] for r in mixing.mix_report(docs, block_words=16).collect()}
    # The mix itself: as many words of each document, cut at word borders.
    mixed = mixing.mix_documents(docs, block_words=16).collect()
    taken = Counter()
    for r in mixed:
        taken[r["doc_id"]] += len(r["text"].split())
    assert {k: r["taken"] for k, r in got.items() if r["taken"]} == dict(taken)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(r["text"] in text[r["doc_id"]] for r in mixed)


def test_mix_against_its_definition(spark):
    """Slots, blocks and shares counted from the mixed texts alone."""
    rng, b = random.Random(52), 16
    sources = ["b", "a", None, "é"]
    texts = [words(rng, rng.choice([1, 5, 40, 400]), 10**6) for _ in range(160)] + [words(rng, 3000, 10**6), None, ""]
    docs = table(spark, texts, sources)
    size = Counter()
    for k, text in enumerate(texts):
        size[sources[k % 4]] += len((text or "").split())
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight, full, total = dict(zip(order, (5, 2, 1, 5), strict=True)), set(), sum(size.values())
    while True:
        left, shares = total - sum(3 * size[s] for s in full), sum(weight[s] for s in order if s not in full)
        target = {s: 3 * size[s] if s in full else left * weight[s] / shares for s in order}
        if not (above := {s for s in order if target[s] > 3 * size[s]}):
            break
        full |= above
    slots = {}
    for r in mixing.mix_documents(docs, block_words=b).collect():
        slots.setdefault(r["slot_"], []).append(r)
    assert sorted(slots) == list(range(len(slots)))
    blocks = {s: Counter() for s in order}
    for pieces in slots.values():
        assert len({r["source"] for r in pieces}) == 1
        blocks[pieces[0]["source"]][tuple(sorted((r["doc_id"], r["text"]) for r in pieces))] += 1
    for s, times in blocks.items():
        assert sum(n * sum(len(x.split()) for _, x in block) for block, n in times.items()) == pytest.approx(target[s], abs=b)
        assert max(times.values()) - (min(times.values()) if len(times) == -(-size[s] // b) else 0) <= 1
        assert sum(sum(len(x.split()) for _, x in block) < b for block in times) <= 1
        once = Counter()
        for block in times:
            for k, x in block:
                once[k] += len(x.split())
        assert all(n <= len(texts[k].split()) for k, n in once.items())
        if min(times.values()) > 0 and len(times) == -(-size[s] // b):
            assert sum(once.values()) == size[s]


def test_mix_of_nothing(spark):
    assert mixing.mix_report(table(spark, [])).count() == 0
    assert mixing.mix_documents(table(spark, [None, ""])).count() == 0
    assert [r["taken"] for r in mixing.mix_report(table(spark, [None, None, "", ""])).collect()] == [0] * 4


# ---- 3 embeddings -----------------------------------------------------------------------------


def check_vectors(spark, rows, kind="float"):
    got = {r["vec_id"]: r for r in embedding_dedup.vector_links(spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>, label int, id string")).collect()}
    usable = {k: np.array(v, np.float32 if kind == "float" else float).astype(float) for k, v, label, _ in rows if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    label = {r[0]: r[2] for r in rows}
    pairs = [(a, b) for a in usable for b in usable if a < b and label[a] == label[b] and len(usable[a]) == len(usable[b]) and usable[a] @ usable[b] / np.linalg.norm(usable[a]) / np.linalg.norm(usable[b]) >= 0.93]
    links = Counter(x for p in pairs for x in p)
    want = groups_of(pairs, [r[0] for r in rows])
    for k, r in got.items():
        assert (r["n_links"], r["component_id"], r["kept"]) == (links[k], want[k], want[k] == k), k
    assert len(got) == len(rows)


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CELL_NODES", 40)
    monkeypatch.setattr(embedding_dedup, "BLOCK_ROWS", 32)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 8))
    rows = []
    for k in range(400):
        v = centres[k % 12] + rng.normal(size=8) * rng.choice([0.05, 0.3, 0.6])
        rows.append((k, [float(x) for x in v.astype(np.float32)], int(k % 3), "x"))
    rows += [(1000 + k, rows[0][1], 0, "x") for k in range(60)]
    rows += [(2000, None, 1, "x"), (2001, [0.0] * 8, 1, "x"), (2002, [1.0, None, *[0.0] * 6], 1, "x"), (2003, [float("nan")] * 8, 1, "x"), (2004, rows[0][1], None, "x"), (2005, [], 1, "x"), (2006, [1.0, 2.0], 0, "x"), (2007, [1.0, 2.0], 0, "x"), (2008, [float("inf")] + [0.0] * 7, 0, "x")]
    check_vectors(spark, rows)


def test_no_vectors(spark):
    check_vectors(spark, [])
    check_vectors(spark, [(1, [1e-30, 2e-30], 1, "x"), (2, [1e30, 2e30], 1, "x"), (3, [-0.0, 1.0], 1, "x"), (4, [0.0, 1.0], 1, "x")])


# ---- 4 token files ----------------------------------------------------------------------------


@given(st.lists(st.integers(0, 6), max_size=400), st.integers(0, 400), st.integers(0, 60))
@settings(max_examples=60, deadline=None)
def test_repair_round_trip(ids, start, length):
    ids = np.array(ids * 3, np.int32)
    grammar, documents = repair.unpack(repair.pack(repair.compress(ids, 7, least_count=3), b"d"))
    assert documents == b"d" and (grammar.ids() == ids).all()
    stop = min(len(ids), start + length)
    assert (grammar.ids_between(start, stop) == ids[start:stop]).all()


def test_repair_finds_rules():
    ids = np.tile(np.arange(50, dtype=np.int32), 100)
    grammar = repair.compress(ids, 50)
    assert len(grammar.rules) and len(grammar.sequence) < len(ids) / 4 and (grammar.ids() == ids).all()


ODD = ["", None, " ", "don't we'll 'S x's… é é. İstanbul Σας! 12.5,7 ?!..", "a \x1c y\x85z ÀÉ, “q”. <|endoftext|>. ß. 漢字 हिन्दी. ́a .́ a.́", "a" * 3000 + ".", "hello <|endoftext|> world x<|endoftext|>y. <|ENDOFTEXT|> q<|startoftext|>!", "A1.B2! c%% 9. é.) x<| y|> \u212a. =\u0338 a=\u0338", "word " * 30000, "日本。 x", "\n\nx\ty\n", "I'm. I'M; can't! 'll. o'. '"]


def test_token_files(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(2)
    texts = ODD + [words(rng, 200) for _ in range(60)]
    folder = token_files.write_token_shards(table(spark, texts), shard_bytes=9000)
    got = {r["id"]: r for r in token_files.token_index(spark, folder).collect()}
    start = 0
    for k, text in enumerate(texts):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        assert (got[k]["start"], got[k]["n_tokens"], got[k]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), k
        start += len(ids)
    read = {r["id"]: r["ids"] for r in token_files.read_token_shards(spark, folder, with_ids=True).collect()}
    assert read[3] == [*library.encode(texts[3], add_special_tokens=False).ids, 2]


def test_token_files_of_few_ranges(spark, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_files, "MOST_RANGES", 2)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(6)
    texts = [words(rng, 60) for _ in range(1500)]
    folder = token_files.write_token_shards(table(spark, texts), shard_bytes=4000)
    got = sorted((r["id"], r["start"], r["n_tokens"]) for r in token_files.token_index(spark, folder).collect())
    want, start = [], 0
    for k, text in enumerate(texts):
        want.append((k, start, len(library.encode(text, add_special_tokens=False).ids) + 1))
        start += want[-1][2]
    assert got == want and token_files.read_token_shards(spark, folder).select("shard").distinct().count() > token_files.MOST_RANGES


def test_token_files_of_nothing(spark):
    assert token_files.token_index(spark, token_files.write_token_shards(table(spark, []))).count() == 0
    rows = [(None, "a b"), (None, "a b"), (4, None)]
    folder = token_files.write_token_shards(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(((r["id"] is not None, r["start"], r["n_tokens"]) for r in token_files.token_index(spark, folder).collect())) == [(False, 0, 3), (False, 3, 3), (True, 6, 1)]


# ---- 5 line dedup -----------------------------------------------------------------------------


def test_alignment_needs_order():
    assert line_dedup.align([(0, 5, True), (1, 6, True), (2, 1, True)]) == [(0, 5), (1, 6)]
    assert line_dedup.align([(0, 0, True), (1, 1, False), (2, 2, True), (3, 1, False)]) == [(0, 0), (1, 1), (2, 2)]
    assert line_dedup.align([]) == []
    # One run, runs that make one block, a block that is moved, and a line that is repeated between anchors.
    assert line_dedup.common_blocks([(3, 4, 0)]) == [(3, 4)]
    assert line_dedup.common_blocks([(3, 4, 0), (4, 5, 1), (9, 9, 12)]) == [(3, 5), (9, 9)]
    assert sorted(line_dedup.common_blocks([(0, 1, 5), (1, 2, 6), (7, 7, 1)])) == [(0, 2), (7, 7)]
    assert line_dedup.common_blocks([(0, 0, 0), (1, 1, 1), (2, 2, 2), (3, 3, 1)]) == [(0, 2), (3, 3)]


@given(st.lists(st.integers(0, 30), max_size=40, unique=True))
@settings(max_examples=80, deadline=None)
def test_longest_increasing(values):
    got = [p for _, p in line_dedup.increasing(list(enumerate(values)))]
    best = [0] * len(values)
    for k, v in enumerate(values):
        best[k] = 1 + max((best[j] for j in range(k) if values[j] < v), default=0)
    assert got == sorted(got) and len(got) == max(best, default=0)


def test_line_dedup_keeps_a_copy_of_common_passages(spark):
    passage = " ".join(f"p{k}" for k in range(60))
    texts = [f"own line {k}\n{passage}\nlast line {k}" for k in range(50)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(table(spark, texts)).collect()}
    assert got[0] == texts[0] and all(passage not in got[k] and f"own line {k}" in got[k] for k in range(1, 50))


def test_line_dedup_of_repeats_and_nothing(spark):
    text = words(random.Random(1), 50)
    rows = [(None, text), (1, text), (1, text)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == [(0, ""), (1, text), (1, text)]
    assert line_dedup.dedup_lines(table(spark, [])).count() == 0


# ---- 6 WARC -----------------------------------------------------------------------------------


def test_warc(spark):
    for url, line in (("a/b/c", "GET / "), ("mailto:x/y/z", "GET / "), ("http:/h/p", "GET / "), ("http://h?q", "GET ?q "), ("http://h", "GET / "), ("//h/p", "GET / "), ("http://h/p\n#", "GET /p%0A# ")):
        assert line.encode() in next(warc.parse_records(next(warc.capture_records("1", "1", url, b"", None, None, False))))[2]
    html = ["<p>a</p>", "<p>b</p>", "<p>a</p>", None, "", "é" * 5000, "<p>a</p>", "<p>a</p>", None, "x\r\n\r\ny"]
    rows = [(k, f"http://h{k}.example/p?{k}" if k != 4 else None, h, "c", 1) for k, h in enumerate(html)] + [(None, "http://n", "<p>a</p>", "c", 1), (9, "http://h9.example/again", "x\r\n\r\ny", "c", 1)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, digest string, id int")
    records = warc.read_records(spark, warc.write_archives(pages, archive_bytes=4000))
    assert {r["kind"]: r["count"] for r in records.groupBy("kind").count().collect()}["request"] == len(rows)
    captures = warc.assemble_captures(records)
    assert captures.count() == len(rows) and captures.where("request is null or metadata is null").count() == 0
    got = Counter(tuple(r) for r in warc.capture_digests(captures).collect())
    want = Counter()
    for page, _, h, _, _ in rows:
        data = (h or "").encode()
        first = min(p for p, _, x, _, _ in rows if (x or "") == (h or "") and p is not None)
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        want[(page, len(data), digest, "response" if page == first else "revisit", None if page == first else first)] += 1
    assert got == want


def test_warc_least_bytes_and_nothing(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab")], "page_id bigint, url string, html string")
    got = warc.capture_digests(warc.assemble_captures(warc.read_records(spark, warc.write_archives(pages, least_bytes=3)))).collect()
    assert [r["record_type"] for r in got] == ["response", "response"]
    empty = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert warc.capture_digests(warc.assemble_captures(warc.read_records(spark, warc.write_archives(empty)))).count() == 0


# ---- 7 tool calls -----------------------------------------------------------------------------


def test_canonical_json():
    assert tool_calls.canonical({"b": 1.0, "a": [True, None, "é\n"], "c": float("nan")}) == '{"a":[true,null,"é\\n"],"b":1,"c":null}'


def test_violations():
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": "array", "items": {"type": "integer", "minimum": 0}}}, "additionalProperties": False}
    assert tool_calls.violations({"a": [1, -1, "x"], "z": 1}, schema) == ["$.z: additionalProperties", "$.a[1]: minimum", "$.a[2]: type"]
    assert tool_calls.violations({}, schema) == ["$.a: required"] and tool_calls.violations(True, {"type": "integer"}) == ["$: type"]


def test_links(spark):
    import json

    call = lambda i, deps=(), name="find", args=None: {"id": i, "name": name, "arguments": args if args is not None else {"q": "x"}, "depends_on": list(deps)}
    rows = [
        (1, 0, "assistant", json.dumps({"tool_calls": [call("c", ["a", "b"]), call("a"), call("b", ["a"], args={"q": 3})]})),
        (1, 1, "tool", json.dumps({"tool_call_id": "a", "content": {"z": 1, "y": 2.0}})),
        (1, 2, "tool", json.dumps({"tool_call_id": "lost", "content": 1})),
        (2, 0, "assistant", json.dumps({"tool_calls": [call("p", ["q"]), call("q", ["p"]), call("r", ["p"], "nope")]})),
        (3, 0, "user", "hello"), (3, 1, "assistant", "hi"), (3, 2, "user", ""), (None, 0, "user", "x"), (None, 1, "assistant", "y"), (4, None, "user", None), (4, 0, None, "{broken"),
    ]
    messages = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("json", F.lit(1)).withColumn("conv", F.lit(2))
    schemas = tool_calls.SCHEMAS | {"find": {"type": "object", "properties": {"q": {"type": "string"}}}}
    got = {(r["conv_id"], r["call_id"], r["turn"] is None): r for r in tool_calls.link_calls(messages, schemas=schemas).collect()}
    assert [got[1, k, False]["level"] for k in "abc"] == [0, 1, 2] and [got[2, k, False]["level"] for k in "pqr"] == [None] * 3
    assert got[1, "a", False]["json"] == '{"arguments":{"q":"x"},"depends_on":[],"id":"a","name":"find","result":{"y":2,"z":1}}'
    assert got[1, "b", False]["errors"] == "$.q: type" and not got[1, "b", False]["valid"] and got[2, "r", False]["errors"] == "unknown tool"
    assert not got[1, "lost", True]["linked"] and got[1, "lost", True]["valid"] is None
    assert got[3, "turn-0", False]["linked"] and got[3, "turn-2", False]["level"] == 1 and got[3, "turn-2", False]["errors"] == "$.text: minLength"
    assert not got[None, "turn-0", False]["linked"] and got[4, "turn-None", True]["errors"] == "$.text: type; $.turn: type"
    assert tool_calls.link_calls(messages.limit(0)).count() == 0


def test_odd_calls(spark):
    import json

    deep = json.dumps({"tool_calls": [{"id": "d", "name": "n", "arguments": json.loads("[" * 900 + "]" * 900)}]})
    rows = [(1, 0, "assistant", '{"tool_calls": [{"id": "a\\ud800", "name": "n", "arguments": "x\\ud800"}]}'), (1, 1, "tool", '{"tool_call_id": "a\\ud800", "content": "\\udfff"}'), (2, 0, "user", deep), (2, 1, "assistant", "[" * 5000)]
    got = {r["conv_id"]: r for r in tool_calls.link_calls(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()}
    assert json.loads(got[1]["json"]) == {"arguments": "x\ud800", "depends_on": [], "id": "a\\ud800", "name": "n", "result": "\udfff"} and got[1]["linked"]
    assert got[2]["linked"] and json.loads(got[2]["json"])["arguments"]["text"] == deep
    with pytest.raises(ValueError, match="pattern"):
        tool_calls.link_calls(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"), schemas={"n": {"properties": {"a": {"pattern": "x"}}}})


def test_levels_of_random_calls(spark):
    # A long chain, random graphs with cycles, and chains that meet in calls of several dependencies.
    rng, rows = random.Random(31), [(0, f"c{k}", [f"c{k - 1}", "unknown"]) for k in range(150)]
    for conv in range(1, 12):
        size = rng.randint(1, 25)
        rows += [(conv, f"c{k}", [f"c{rng.randrange(size if conv % 3 == 0 else max(1, k))}" for _ in range(rng.choice([0, 1, 1, 1, 2, 3]))] if k or conv % 3 == 0 else []) for k in range(size)]
    known = {(c, i): {(c, d) for d in deps} for c, i, deps in rows}
    want = dict.fromkeys(known)
    for _ in range(len(known)):
        for call, deps in known.items():
            deps = [d for d in deps if d in known]
            if want[call] is None and all(want[d] is not None for d in deps):
                want[call] = max((want[d] + 1 for d in deps), default=0)
    got = tool_calls.call_levels(spark.createDataFrame(rows + rows[:3], "conv bigint, call_id string, depends_on array<string>")).collect()
    assert {(r["conv"], r["call_id"]): r["level"] for r in got} == want and len(got) == len(known)
    assert max(x or 0 for x in want.values()) == 149 and None in want.values()


# ---- 8 byte-level BPE -------------------------------------------------------------------------


def library_codec():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


LIBRARY = library_codec()
ALPHABET = st.text(alphabet="ab'ls re1 \n\t\x1c\x85 é漢!.?", max_size=120)


@given(ALPHABET, st.integers(2, 20))
@settings(max_examples=300, deadline=None)
def test_tree_encodes_like_the_library(text, leaf):
    codec = byte_bpe.TreeCodec(LIBRARY.encode_ordinary, byte_bpe.load_codec(RANKS, public_tokenizers.PATTERN).token_bytes, leaf)
    ids = codec.encode(text)
    assert ids == LIBRARY.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


def test_long_texts():
    codec = byte_bpe.load_codec(RANKS, public_tokenizers.PATTERN, 64)
    rng = random.Random(9)
    assert codec.encode(" " * 10**6) == LIBRARY._encode_single_piece(" " * 10**6)
    assert codec.encode("x" + "\n" * 20000 + "y") == LIBRARY.encode_ordinary("x" + "\n" * 20000 + "y")
    assert codec.encode("a b " + "c" * 300000) == LIBRARY.encode_ordinary("a b " + "c" * 300000)
    for text in ("a" * 5000, " " * 3000, words(rng, 3000), "x\n" * 2000, "'" * 999 + "ll"):
        assert codec.encode(text) == LIBRARY.encode_ordinary(text)


def test_digests(spark):
    texts = ["Hello  world's end", None, "", "é\n"]
    got = {r["doc_id"]: r for r in byte_bpe.encode_digests(table(spark, texts)).collect()}
    for k, t in enumerate(texts):
        ids = LIBRARY.encode_ordinary(t or "")
        assert (got[k]["n_tokens"], got[k]["ids_sha256"], got[k]["decoded_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    encoded = byte_bpe.encode_documents(table(spark, texts))
    assert {r["doc_id"]: bytes(r["content"]) for r in byte_bpe.decode_documents(encoded).collect()} == {k: (t or "").encode() for k, t in enumerate(texts)}
    assert byte_bpe.encode_digests(table(spark, [])).count() == 0


# ---- 9 quality --------------------------------------------------------------------------------


def test_quality_facts():
    text = "a b c d e f\na b c d e\n\n a b c d e\nx # y"
    f = quality.TextFacts(text)
    win = [tuple(f.words[k : k + 5]) for k in range(f.n_words - 4)]
    covered = {k + i for k, w in enumerate(win) if win.count(w) > 1 for i in range(5)}
    assert (f.n_words, f.n_repeat_words, f.n_dup_lines, f.n_symbols) == (19, len(covered), 0, 1)
    assert f.word_chars == 19 and quality.TextFacts("a\na\n \n \nb").n_dup_lines == 1
    assert quality.TextFacts(None).n_words == 0


def brute_quality(text):
    """Counts and verdict of a text, straight from the definitions."""
    import re

    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:k] for k, x in enumerate(lines))
    win = [w[k : k + 5] for k in range(len(w) - 4)]
    covered = {k + i for k, x in enumerate(win) for i in range(5) if any(x == y for j, y in enumerate(win) if j != k)}
    chars, symbols = sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text))
    base = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    upper, lower = len(re.findall("[A-Z]", text)), len(re.findall("[a-z]", text))
    size = lambda x: len(x.encode())
    bad = 10 * symbols > len(w) or 10 * dup > 3 * len(lines) or (len(w) >= 10 and upper > 0.3 * max(1, upper + lower)) or (w and not 2 * len(w) <= chars <= 20 * len(w)) or sum(size(x) for x in w if size(x) > 40) > 0.3 * max(1, sum(map(size, w)))
    return len(w), chars, symbols, dup, len(covered), base, not base and not bad


def test_quality_of_a_table(spark):
    rng = random.Random(41)
    texts = ["", None, " \n", "\x1c\x85 a\u3000b", "word " * 5000, "é" * 3000, "A B " * 60]
    for _ in range(150):
        lines = [words(rng, rng.randint(0, 12), rng.choice([3, 30, 10**6])) for _ in range(rng.randint(1, 8))]
        lines += [rng.choice(lines)] * rng.choice([0, 0, 1, 3])
        texts.append(rng.choice(["\n", "\n \n", "\x0b\n"]).join(lines).replace("w1", rng.choice(["w1", "W1", "#", "é1", "x" * 45])))
    texts += texts[:20]
    got = {r["doc_id"]: tuple(r)[1:] for r in quality.quality_report(table(spark, texts)).collect()}
    want = {k: brute_quality(t) for k, t in enumerate(texts)}
    assert got == want and 20 < sum(v[-1] for v in want.values()) < 150
    assert sorted(r["doc_id"] for r in quality.filter_documents(table(spark, texts)).collect()) == [k for k, v in want.items() if v[-1]]


def test_cascade(spark):
    rng = random.Random(3)
    clean = [words(rng, 80, 10**6) for _ in range(20)]
    bad = [" ".join(f"{w}$$$" for w in clean[0].split()), clean[1].upper() * 1, "w " * 200, "short", None, "", "\n".join(["the same line over and over"] * 9)]
    docs = table(spark, clean + bad)
    report = {r["doc_id"]: r for r in quality.quality_report(docs).collect()}
    assert all(report[k]["kept"] for k in range(20)) and not any(report[k]["kept"] for k in range(20, 27))
    assert report[24]["base_failed"] and report[24]["n_words"] == 0 and not report[20]["base_failed"]
    kept = quality.filter_documents(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == list(range(20))
    assert quality.filter_documents(table(spark, [])).count() == 0


def test_order_by_rejection_per_cost(spark):
    import time

    slow = quality.Rule("slow", lambda f: time.sleep(0.002) or f.n_words < 3)
    fast = quality.Rule("fast", lambda f: f.n_words < 3)
    never = quality.Rule("never", lambda f: False)
    docs = table(spark, ["a b", "a b c d"] * 10)
    assert [r.name for r in quality.order_rules(docs, (never, slow, fast))] == ["fast", "slow", "never"]


def brute_runs(texts, least=20):
    """Places of lines in runs of adjacent lines with enough words that an earlier text has as well."""
    docs = [[line.strip() for line in (t or "").split("\n") if line.strip()] for t in texts]
    seen, out = set(), []
    for lines in docs:
        runs = [(a, b) for a in range(len(lines)) for b in range(a, len(lines)) if sum(len(x.split()) for x in lines[a : b + 1]) >= least]
        out.append({p for a, b in runs if tuple(lines[a : b + 1]) in seen for p in range(a, b + 1)})
        seen |= {tuple(lines[a : b + 1]) for a, b in runs}
    return out


def remaining(texts, gone):
    """The texts without the lines at these places among those with words."""
    out = []
    for text, places in zip(texts, gone, strict=True):
        lines, kept, place = (text or "").split("\n"), [], 0
        for line in lines:
            if not line.strip() or place not in places:
                kept.append(line)
            place += bool(line.strip())
        out.append("\n".join(kept) if places else text)
    return out


def op5(spark, path, texts):
    table(spark, texts).write.parquet(f"{path}/documents.parquet")
    return {r["doc_id"]: r for r in line_dedup.op5_line_dedup(spark, str(path)).collect()}


def test_op5_deletes_passages_of_lines_with_different_first_holders(spark, tmp_path):
    a, b, rare = (" ".join(f"{c}{k}" for k in range(n)) for c, n in (("a", 12), ("b", 12), ("r", 6)))
    texts = [f"one\n{a}", f"two\n{b}"] + [f"own {k}\n{a}\n{b}\nlast {k}" for k in range(11)]
    # Rare, common and rare lines: below 20 words without the common one.
    common = "c1 c2 c3 c4 c5 c6 c7 c8"
    texts += [f"it {k}\n{common}" for k in range(12)] + [f"x {k}\n{rare}\n{common}\nz{rare}\ny {k}" for k in range(2)]
    got = op5(spark, tmp_path, texts)
    assert [got[k]["text"] for k in range(3)] == texts[:3]
    assert all(got[k]["text"] == f"own {k - 2}\nlast {k - 2}" for k in range(3, 13))
    assert got[25]["text"] == texts[25] and got[26]["text"] == "x 1\ny 1"


def test_op5_deletes_every_repeated_run(spark, tmp_path):
    rng = random.Random(16)
    passages = [words(rng, rng.randint(3, 30), 5000) for _ in range(25)]
    order = [rng.sample(passages, 4) for _ in range(8)]
    texts = ["\n".join([words(rng, 5, 10**6), *rng.choice(order)[: rng.randint(1, 4)], rng.choice(passages), words(rng, 4, 10**6)]) for _ in range(150)]
    texts += [texts[3], texts[5] + "\n\nmore of it", None, "", "\n \n"]
    got, want = op5(spark, tmp_path, texts), brute_runs(texts)
    assert [got[k]["text"] for k in range(len(texts))] == remaining(texts, want)
    assert [got[k]["n_deleted"] for k in range(len(texts))] == [len(x) for x in want] and sum(map(bool, want)) > 50


# ---- 10 SimHash -------------------------------------------------------------------------------


def brute_fingerprint(text, size=3):
    import xxhash

    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(w[k : k + size]) for k in range(max(1, len(w) - size + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_texts(rng, n=150):
    texts = [words(rng, rng.randint(0, 120)) for _ in range(n)]
    for k in range(n):
        w = texts[k].split()
        if len(w) > 40 and rng.random() < 0.5:
            w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    return texts + [texts[5]] * 4 + ["", None, " \n", "one", "two words", "ÀÉ Straße A", "àé straße a"]


@pytest.mark.parametrize("block", [512, 4])
def test_simhash(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK_ROWS", block)
    texts = near_texts(random.Random(8))
    got = {r["doc_id"]: r for r in simhash.near_duplicates(table(spark, texts)).collect()}
    prints = [brute_fingerprint(t) for t in texts]
    assert [got[k]["fingerprint"] for k in range(len(texts))] == [f"{p:016x}" for p in prints]
    want = groups_of([(a, b) for a in range(len(texts)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3], range(len(texts)))
    assert {k: r["component_id"] for k, r in got.items()} == want


def test_simhash_leaves_few_files(spark, monkeypatch):
    # Many small partitions, as on a large cluster: the tables of the fingerprints have a file per core.
    import glob

    def files():
        return {f for f in glob.glob(spark.conf.get("spark.checkpoint.dir").removeprefix("file://") + "/quern-*/part-*")}

    texts, before, written = near_texts(random.Random(9)), files(), []
    monkeypatch.setattr(graph, "drop_folder", lambda spark, path: None)  # the rounds of the components stay
    names = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    kept = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(table(spark, texts)).collect()}
        written = [f.split("/")[-2] for f in files() - before]
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    prints = [brute_fingerprint(t) for t in texts]
    assert got == groups_of([(a, b) for a in range(len(texts)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3], range(len(texts)))
    counts = {f: written.count(f) for f in written}
    assert {f.split("-")[1] for f in counts} == {"simhash", "cc"} and max(counts.values()) <= spark.sparkContext.defaultParallelism


def test_links_are_complete(spark):
    rng = random.Random(11)
    base = [rng.getrandbits(64) for _ in range(30)]
    prints = set(base)
    for b in base:
        for _ in range(8):
            f = b
            for bit in rng.sample(range(64), rng.randint(1, 4)):
                f ^= 1 << bit
            prints.add(f)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame, place = spark.createDataFrame([(p,) for p in signed], "fp bigint"), {p: k for k, p in enumerate(signed)}
    want = groups_of([(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3], range(len(prints)))
    for block in (512, 3):
        edges = [(place[r["a"]], place[r["b"]]) for r in simhash.links(frame, 3, block).collect()]
        assert groups_of(edges, range(len(prints))) == want
        assert all((prints[a] ^ prints[b]).bit_count() <= 3 for a, b in edges)


def test_near_copies(spark):
    rng = random.Random(12)
    texts = [words(rng, 150, 10**6) for _ in range(40)]
    copies = []
    for k in range(20):
        w = texts[k].split()
        w[70] = "changed"
        copies.append(" ".join(w))
    docs = table(spark, texts + copies + texts[:3])
    kept = simhash.keep_one_copy(docs)
    assert kept.columns == docs.columns
    ids = sorted(r["doc_id"] for r in kept.collect())
    assert set(range(40)) <= set(ids) and len(ids) <= 42 and not set(ids) & {60, 61, 62}
    twice = table(spark, ["a b c d e f g h"] * 1).union(table(spark, ["a b c d e f g h"]))
    assert simhash.keep_one_copy(twice).count() == 1
    assert simhash.keep_one_copy(table(spark, [])).count() == 0


def brute_groups(texts, size=5, similarity=0.8):
    """Groups by the Jaccard similarity of all pairs of texts."""
    sets = []
    for t in texts:
        w = (t or "").split()
        sets.append({tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set())
    linked = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] == sets[b] or len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) > 0]
    return groups_of(linked, range(len(sets)))


@pytest.mark.parametrize("upto", [32, 1])
def test_near_copies_of_a_large_family(spark, monkeypatch, upto):
    # Each of 80 variants links with the base only, whose id is the greatest of all.
    monkeypatch.setattr(simhash, "PAIRS_UPTO", upto)
    monkeypatch.setattr(simhash, "SET_BLOCK_ROWS", 16, raising=False)
    rng = random.Random(21)
    base, texts = words(rng, 300, 10**6).split(), []
    for k in range(80):
        w = list(base)
        for at in rng.sample(range(10, 290), 6):
            w[at] = f"v{k}x{at}"
        texts.append(" ".join(w))
    texts.append(" ".join(base))
    want = brute_groups(texts)
    assert len(set(want.values())) == 1 and len(set(brute_groups(texts[:80]).values())) > 40
    assert [r["doc_id"] for r in simhash.keep_one_copy(table(spark, texts)).collect()] == [0]


def test_near_copies_are_complete(spark):
    # Pairs from 0.6 to 0.95, many of them just at 0.8, short ones included, and two texts of equal word pairs.
    rng = random.Random(22)
    texts = []
    for _ in range(150):
        w = words(rng, rng.choice([12, 30, 60, 200]), 10**6).split()
        other = list(w)
        for at in rng.sample(range(len(w)), max(1, len(w) // 60) + rng.randrange(2)):
            other[at] = f"v{rng.randrange(10**6)}"
        texts += [" ".join(w), " ".join(other), " ".join(w[: len(w) - len(w) // 6])]
    texts += ["", None, " \n", "a b c d e f", "a a a a a a a", "a a", "a a a a a a a a a"]
    docs = table(spark, texts)
    got = {r["id"]: r["group"] for r in simhash.near_copies(docs).collect()}
    want = brute_groups(texts)
    assert groups_of([(a, b) for a in got for b in got if got[a] == got[b]], range(len(texts))) == want
    assert 200 < len(set(want.values())) < len(texts) - 50
