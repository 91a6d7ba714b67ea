from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from quern.__main__ import main
from quern.corpus import CORPORA
from quern.operators import aliases, encode, evaluation, panels
from quern.operators.lexicon import Alias, Entity, Lexicon, load_lexicon
from quern.sources import archives, html_tables, metadata
from quern.streaming import chunks

S2, AX = CORPORA["s2orc"], CORPORA["arxiv"]
LEXICON = """version: 0.3
context_terms: {g: [gpu]}
models:
- {id: ax, display: AX, manufacturer: nvidia, segment: datacenter, release: 2017-05, fp32_gflops: 10.0, vram_gb: 16.0, aliases: [AX 100]}
- {id: card, display: card, manufacturer: nvidia, kind: generic, aliases: [card]}
"""


def made_aliases(spark, rows, claimed=None):
    df = aliases.make_aliases(spark.createDataFrame(rows, "id string, name string, vendor string"), claimed)
    return {(r["id"], r["form"]): (r["gate"], r["case"]) for r in df.collect()}


def test_bare_codes_are_gated_denied_or_claimed(spark):
    got = made_aliases(spark, [("a", "Tesla K80", "NVIDIA"), ("b", "Tesla T4", "NVIDIA"), ("c", "Xeon 7210", "Intel"), ("d", "Quadro K80", "NVIDIA"), ("e", "Instinct MI50", "AMD"), ("f", None, None)])
    assert got["a", "K80"] == ("gpu", "auto") and got["a", "NVIDIA K80"] == (None, "insensitive")
    assert ("b", "T4") not in got and got["b", "Tesla T4"] == (None, "insensitive") and ("b", "NVIDIA T4") in got
    assert ("d", "K80") not in got and ("c", "7210") not in got
    assert not any(k[0] == "f" for k in got)
    taken = spark.createDataFrame([("MI50",)], "form string")
    assert ("e", "MI50") in got and ("e", "MI50") not in made_aliases(spark, [("e", "Instinct MI50", "AMD")], taken)


def test_spellings_of_brackets_boards_and_closed_names(spark):
    got = made_aliases(spark, [("a", "Maia 100 80 GB PCIe", "Microsoft"), ("b", "MTIA v2 (MTIA 200) (PCIe) (150W)", "Meta"), ("c", "Gaudi2", "Intel"), ("d", "  ", "Intel")])
    assert {f for i, f in got if i == "a"} == {"Maia 100", "Microsoft Maia 100"}
    assert ("b", "MTIA 200") in got and ("b", "MTIA v2") in got and ("b", "PCIe") not in got and ("b", "150W") not in got
    assert ("c", "Gaudi 2") in got


def test_colliding_ids(spark):
    frame = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    got = aliases.colliding(frame("a-b-c", "a", "ab", "x-y", "q"), frame("a-b", "x-y-z", "abc")).collect()
    assert sorted(r["id"] for r in got) == ["a", "a-b-c", "x-y"]
    assert aliases.colliding(frame("a"), frame("a").where("false")).count() == 0
    ids = spark.createDataFrame([("Tesla K80", "nvidia"), ("NVIDIA A1", "nvidia"), ("X 1", None)], "n string, v string").select(aliases.entry_id(F.col("n"), F.col("v")).alias("i")).collect()
    assert [r["i"] for r in ids] == ["nvidia-tesla-k80", "nvidia-a1", "x-1"]


def test_tables_with_spans_heads_and_open_ends(spark):
    html = "<h2>Parts <b>A</b></h2><h3>New</h3><table class='x wikitable'><tr><th rowspan=2>Model</th><th colspan=2>Processing power (TFLOPS)</th></tr><tr><th>Single</th><th>Tensor dense</th></tr><tr><td rowspan='2'>P&amp;1[1]</td><td>1,000.5 (2,000)</td><td>-</td></tr><tr><td>3<script>var x='<td>'</script></td><td>4</td></tr></table><table><tr><td>no</td></tr></table><h2>Next</h2><table class=wikitable><tr><th>Name<th>TDP (W)<tr><td>Q<td>300"
    pages = spark.createDataFrame([(1, html), (2, None), (3, ""), (4, "<table class=wikitable></table>")], "page int, html string")
    rows = html_tables.table_rows(pages, "page", "html", "wikitable")
    assert [(r["page"], r["section"], r["heading"], r["header"], r["cells"]) for r in rows.orderBy("table", "row").collect()] == [
        (1, "Parts A", "New", ["Model", "Processing power (TFLOPS) Single", "Processing power (TFLOPS) Tensor dense"], ["P&1[1]", "1,000.5 (2,000)", "-"]),
        (1, "Parts A", "New", ["Model", "Processing power (TFLOPS) Single", "Processing power (TFLOPS) Tensor dense"], ["P&1[1]", "3", "4"]),
        (1, "Next", "", ["Name", "TDP (W)"], ["Q", "300"]),
    ]
    specs = html_tables.specifications(rows, "page").orderBy("table", "row").collect()
    assert [(r["name"], r["fp32_gflops"], r["fp16_tensor_gflops"], r["tdp_w"]) for r in specs] == [("P&1", 2000000.0, None, None), ("P&1", 3000.0, 4000.0, None), ("Q", None, None, 300.0)]
    assert html_tables.table_rows(pages, "page", "html").count() == 4
    assert html_tables.table_rows(pages.where("false"), "page", "html").count() == 0


def test_column_kinds(spark):
    heads = {
        "Processing power (TFLOPS) Single precision": ("fp32_gflops", 1000.0), "Processing power (GFLOPS) Double": ("fp64_gflops", 1.0), "TFLOPS Half precision Tensor Core FP32 Accumulate": ("fp16_tensor_gflops", 1000.0),
        "Vector TFLOPS": ("fp32_gflops", 1000.0), "Vector FP16 TFLOPS": None, "Tensor sparse TFLOPS": None, "Memory size (MB)": ("vram_gb", 1 / 1024), "TDP (watts)": ("tdp_w", 1.0), "Launch": None, None: None,
    }
    df = spark.createDataFrame([(h,) for h in heads], "h string").select("h", html_tables.column_kind(F.col("h")).alias("k"))
    assert {r["h"]: (r["k"]["field"], r["k"]["factor"]) if r["k"] else None for r in df.collect()} == heads


def test_taxonomy_of_headings():
    page = "<h2>Group Name</h2><h4>x.Y (No)</h4><h2>Computer Science</h2><h4>cs.LG <span>(Machine (deep) Learning)</span></h4><h4>cs.AI (AI)</h4><h2>Maths</h2><h4>none</h4><h4>math.CO (Combinatorics)</h4>"
    groups, names = html_tables.taxonomy(html_tables.headings(page))
    assert groups == {"Computer Science": ["cs"], "Maths": ["math"]}
    assert names == {"cs.LG": "Machine (deep) Learning", "cs.AI": "AI", "math.CO": "Combinatorics"}


def test_chunks_go_on_where_they_stopped(spark, tmp_path):
    work = spark.createDataFrame([(i, f"t{i}") for i in range(50)], "k long, text string")
    out, seen = str(tmp_path / "out"), []

    def make(rows):
        seen.append(1)
        if len(seen) == 2:
            raise RuntimeError("lost")
        return rows

    with pytest.raises(RuntimeError):
        chunks.run_missing(work, "k", 6, out, make, at_once=2)
    assert chunks.run_missing(work, "k", 6, out, make, at_once=2) == 4
    assert chunks.run_missing(work, "k", 6, out, make) == 0
    assert sorted(r["k"] for r in spark.read.parquet(f"{out}/data").collect()) == list(range(50))
    with pytest.raises(ValueError):
        chunks.run_missing(work, "k", 7, out, make)


def test_usable_rows_and_first_parts(spark, tmp_path):
    df = spark.createDataFrame([(1, "a" * 21), (2, "a" * 20), (3, None), (4, "b" * 30)], "corpusid long, text string")
    ids = spark.createDataFrame([(1,), (1,), (3,)], "corpusid long")
    assert [r["corpusid"] for r in chunks.usable_rows(df, ["corpusid"], ids, text="text").collect()] == [1]
    assert chunks.usable_rows(df, ["corpusid"]).count() == 4
    df.repartition(3).write.parquet(str(tmp_path / "p"))
    assert chunks.first_parts(spark, str(tmp_path / "p"), 10).count() == 4 and chunks.first_parts(spark, str(tmp_path / "p"), 1).count() < 4


def test_manifest_is_read_once(spark, tmp_path):
    (tmp_path / "m.xml").write_text("<m><file><filename>f</filename><yymm>0704</yymm><num_items>1</num_items><size>2</size><content_md5sum>x</content_md5sum></file></m>")
    first = archives.cached_manifest(spark, str(tmp_path / "m.xml"), str(tmp_path / "cache")).collect()
    (tmp_path / "m.xml").unlink()
    assert archives.cached_manifest(spark, str(tmp_path / "m.xml"), str(tmp_path / "cache")).collect() == first and first[0]["year"] == 2007


def test_recall_of_marked_spans(spark, tmp_path):
    lex = Lexicon("1", {"m": Entity("m", "M", "v"), "k": Entity("k", "K", "v"), "g": Entity("g", "G", "v", "generic")}, (Alias("m", "MX 10"), Alias("k", "K80", "gpu"), Alias("g", "boards")), {"gpu": ("gpu",)})
    lines = [
        {"text": "MX 10 here", "label": [[0, 5, "Hardware-device"]], "Comments": {"paper_id": "p"}},
        {"text": "a K80 here", "label": [[2, 5, "HARDWARE-DEVICE"], [0, 1, "other"]], "Comments": {"paper_id": "p"}},
        {"text": "a K80 here", "label": [[2, 5, "hardware-device"]], "Comments": {"paper_id": "q"}},
        {"text": "an FPGA and boards", "label": [[3, 7, "hardware-device"], [12, 18, "hardware-device"]]},
        {"text": "nothing", "label": []},
    ]
    (tmp_path / "g.jsonl").write_text("\n".join(map(json.dumps, lines)))
    spans = evaluation.judged_spans(evaluation.gold_sentences(spark, str(tmp_path / "g.jsonl")), lex)
    got = sorted((r["paper_id"], r["surface"], r["local"], r["rescued"], r["as_model"], r["bucket"]) for r in spans.collect())
    assert [g[:5] for g in got] == [("?", "FPGA", False, False, False), ("?", "boards", True, True, False), ("p", "K80", False, True, True), ("p", "MX 10", True, True, True), ("q", "K80", False, False, False)]
    assert tuple(evaluation.recall(spans).first()) == (5, 0.4, 0.6, 0.4)
    assert {r["bucket"]: (r["n"], r["share"]) for r in evaluation.misses(spans).collect()} == {"fpga-generic": (1, 0.2), "unknown": (1, 0.2)}
    assert evaluation.recall(spans.where("false")).first()["spans"] == 0


def test_denominator_counts_a_paper_once(spark):
    inventory = spark.createDataFrame([("1", True, False, 5), ("1", True, True, 9), ("2", False, False, 0), ("x", True, False, 1)], "paper_id string, has_body boolean, is_candidate boolean, body_chars int")
    meta = spark.createDataFrame([(1, 2001, "f")], "corpusid long, year int, field string")
    got = {r["corpusid"]: (r["body_chars"], r["is_candidate"], r["year"]) for r in panels.denominator(S2, inventory, meta).collect()}
    assert got == {1: (9, True, 2001), 2: (0, False, None), None: (1, False, None)}
    other = panels.denominator(AX, inventory, spark.createDataFrame([("2", 1999, "g")], "paper_id string, year int, field string"))
    assert {r["paper_id"] for r in other.collect()} == {"1", "2", "x"}


def test_citations_by_corpus(spark):
    focal = spark.createDataFrame([(1, 2019), (2, 2022), (3, None)], "corpusid long, year int")
    names = ("i_1", "i_3", "i_5", "i_10", "cd_5", "cd_10", "bcites_300")
    outcomes = spark.createDataFrame([("1", *range(7)), ("z", *range(7))], "record_id string, " + ", ".join(f"{n} int" for n in names))
    got = {r["corpusid"]: (r["citations_5y"], r["disruption_5y"], r["window_complete"], r["has_outcomes"]) for r in panels.citations(S2, focal, outcomes).collect()}
    assert got == {1: (2, 4, True, True), 2: (None, None, False, False)}
    with pytest.raises(ValueError):
        panels.citations(AX, focal, outcomes)


def test_metadata_audit(spark):
    snapshot = spark.createDataFrame(
        [("0704.0001", "cs.LG", [("v1", "Mon, 2 Apr 2007 19:18:42 GMT")]), ("0704.0002", "zz.A", [("v1", "Mon, 2 Apr 2008 19:18:42 GMT")]), ("", "cs.LG", None), (None, None, None)],
        "id string, categories string, versions array<struct<version:string,created:string>>",
    ).select("id", "categories", F.lit("t").alias("title"), F.lit(" ").alias("abstract"), "versions", *[F.lit(None).cast("string").alias(c) for c in ("license", "doi", "journal-ref")])
    out = metadata.audit(snapshot, metadata.normalise(snapshot, {"cs": "Computing"}))
    assert out["bad"].first()[0] == 2 and [tuple(r) for r in out["unmapped"].collect()] == [("zz", 1)]
    assert out["agreement"].first().asDict() == {"n": 2, "field_share": 0.5, "abstract_share": 0.0, "year_agreement": 0.5}


def test_commands_from_mentions_to_topics(spark, tmp_path, capsys):
    (tmp_path / "lex.yaml").write_text(LEXICON)
    lex, at = str(tmp_path / "lex.yaml"), lambda n: str(tmp_path / n)
    kinds = "paper_id string, status string, usage_context string, model_normalized string, manufacturer string, accelerator_subtype string, device_count int, device_count_basis string, memory_gb double"
    used = "used-in-this-work"
    spark.createDataFrame([("p0", "ok", used, "AX 100", "nvidia", "gpu", 4, "explicit", None), ("p0", "ok", used, "AX 100", "nvidia", "gpu", 2, "explicit", None), ("p1", "ok", used, "AX 100", "other", "gpu", None, None, 8.0), ("p2", "ok", used, "a card", "amd", None, 9, "explicit", None), ("p3", "json_error", None, None, None, None, None, None, None)], kinds).write.parquet(at("mentions"))
    words = ("alpha beta gamma", "delta epsilon zeta")
    spark.createDataFrame([(f"p{i}", 2018 if i != 1 else None, "f", f"t{i}", f"{words[i % 2]} in an abstract of some length") for i in range(12)], "paper_id string, year int, field string, title string, abstract string").write.parquet(at("meta"))
    spark.createDataFrame([(f"p{i}", True, i < 3, 10) for i in range(5)], "paper_id string, has_body boolean, is_candidate boolean, body_chars int").write.parquet(at("inventory"))
    shared = ["--metadata", at("meta")]
    assert main(["compute", "--input", at("mentions"), "--lexicon", lex, "--out", at("c"), "--mentions-version", "0.2", *shared]) == 0
    got = {r["paper_id"]: (r["reported_fp32"], r["reported_vram"], r["year"], r["any_datacenter"], r["spec_registry_version"], r["mentions_registry_version"]) for r in spark.read.parquet(at("c")).collect()}
    assert got["p0"] == (40.0, 64.0, 2018, True, "0.3", "0.2") and got["p1"] == (10.0, 8.0, None, True, "0.3", "0.2")
    assert main(["compute", "--input", at("mentions"), "--lexicon", lex, "--out", at("e"), "--policy", "explicit", *shared]) == 0
    assert "p1" not in {r["paper_id"] for r in spark.read.parquet(at("e")).collect()}
    assert main(["denominator", "--input", at("inventory"), "--mentions", at("mentions"), "--lexicon", lex, "--out", at("d"), *shared]) == 0
    assert spark.read.parquet(at("d/denominator")).count() == 5
    flags = {r["paper_id"]: (r["model_specific"], r["generic_only"], r["n_models"], r["vendors"], r["max_device_count"]) for r in spark.read.parquet(at("d/paper_flags")).collect()}
    assert flags == {"p0": (True, False, 1, ["nvidia"], 4), "p1": (True, False, 1, [], None), "p2": (False, True, 0, ["amd"], 9)}
    assert main(["embed", "--input", at("mentions"), "--out", at("v"), "--chunks", "3", "--size", "8", *shared]) == 0
    assert main(["embed", "--input", at("mentions"), "--out", at("v"), "--chunks", "3", "--size", "8", *shared]) == 0
    assert "0 of 3" in capsys.readouterr().out
    assert {r["paper_id"] for r in spark.read.parquet(at("v/data")).collect()} == {"p0", "p1", "p2"}
    encode.encode(spark.read.parquet(at("meta")).select("paper_id", F.col("abstract").alias("text")), "paper_id", encode.hashing_encoder(8), 8).write.parquet(at("all"))
    assert main(["cluster", "--input", at("all"), "--out", at("t"), "--clusters", "2", "--least-docs", "2", "--reduce-outliers", *shared]) == 0
    assert spark.read.parquet(at("t/assignments")).where("topic_id is not null").count() == 12
    assert {len(r["rep_keys"]) > 0 for r in spark.read.parquet(at("t/topics")).collect()} == {True}
    assert json.loads(spark.read.text(at("t/params")).first()[0])["papers"] == 12


def test_enriched_mentions_of_a_corpus(spark, tmp_path):
    (tmp_path / "lex.yaml").write_text(LEXICON)
    rows = spark.createDataFrame([(1, "ok", "used-in-this-work", "AX 100"), (2, "ok", "object-of-study", "AX 100"), (3, "none", None, None)], "corpusid long, status string, usage_context string, model_normalized string")
    population = spark.createDataFrame([(1, 2001, "f")], "corpusid long, year int, field string")
    got = panels.enriched(S2, rows, population, load_lexicon(tmp_path / "lex.yaml")).collect()
    assert [(r["corpusid"], r["canonical_model"], r["release_year"], r["year"]) for r in got] == [(1, "ax", 2017, 2001)]


def test_pages_are_dealt_out_and_their_rows_leave_together(spark, monkeypatch):
    from quern.plans import source_queries

    monkeypatch.setattr(source_queries, "PAGES_PER_TASK", 30)
    pages = source_queries._spec_pages(spark, "/root/testdata/sf0.001")
    assert pages.rdd.getNumPartitions() == -(-pages.count() // 30) > 4
    assert {r["p_partkey"] for r in html_tables.table_rows(pages, "p_partkey", "html", "wikitable").select("p_partkey").collect()} == {r["p_partkey"] for r in pages.select("p_partkey").collect()}
    many = spark.range(0, 700, 1, 1).select("id", F.repeat(F.concat(F.lit("<table><tr><td>"), "id", F.lit("</td></tr></table>")), (F.col("id") % 9).cast("int")).alias("html"))
    got = {r["id"]: (r["n"], r["cells"]) for r in html_tables.table_rows(many, "id", "html").groupBy("id").agg(F.count("*").alias("n"), F.collect_set(F.col("cells")[0]).alias("cells")).collect()}
    assert got == {k: (k % 9, [str(k)]) for k in range(700) if k % 9}
