from __future__ import annotations

import json

import pytest

from quern.__main__ import main, parser
from quern.operators import encode
from quern.sources import specs

LEXICON = "version: 0.3\ncontext_terms: {g: [gpu]}\nmodels:\n- {id: ax, display: AX, manufacturer: M, aliases: [AX 100]}\n"


def test_scan_to_mentions(spark, tmp_path):
    (tmp_path / "lex.yaml").write_text(LEXICON)
    (tmp_path / "in.jsonl").write_text(json.dumps({"corpusid": 7, "body": {"text": "We trained the model on 4 AX 100 cards for a week.\n\nNothing else of note is in this text at all.", "annotations": None}}))
    out = str(tmp_path / "out")
    assert main(["scan", "--input", str(tmp_path / "in.jsonl"), "--lexicon", str(tmp_path / "lex.yaml"), "--out", out]) == 0
    assert spark.read.parquet(f"{out}/inventory").first()["is_candidate"]
    candidates = f"{out}/candidates/registry_version=0.3"
    assert main(["repack", "--input", candidates, "--out", f"{out}/r", "--shard-size", "1"]) == 0
    assert [tuple(r) for r in spark.read.parquet(f"{out}/r/manifest").collect()] == [(0, 1, 1)]
    assert main(["extract", "--input", candidates, "--out", f"{out}/m", "--pattern", "AX 100"]) == 0
    row = spark.read.parquet(f"{out}/m").first()
    assert (row["status"], row["model_raw"], row["device_count"]) == ("ok", "AX 100", 4)
    assert main(["precision", "--input", candidates, "--out", f"{out}/p"]) == 0
    with pytest.raises(SystemExit):
        parser().parse_args(["scan"])


def test_worklist_and_encoder(spark):
    mentions = spark.createDataFrame([(1, "ok"), (1, "ok"), (2, "json_error"), (3, "ok")], "k int, status string")
    abstracts = spark.createDataFrame([(1, "an abstract that is long enough"), (2, "another one that is long enough"), (3, "short")], "k int, abstract string")
    titles = spark.createDataFrame([(1, "Title")], "k int, title string")
    work = encode.worklist(mentions, abstracts, titles, "k")
    assert [tuple(r) for r in work.collect()] == [(1, "Title [SEP] an abstract that is long enough")]
    vector = encode.encode(work, "k", encode.hashing_encoder(16), 16).first()["embedding"]
    assert sum(x * x for x in vector) == pytest.approx(1.0, abs=1e-5)


def test_specs(spark, tmp_path):
    (tmp_path / "s.csv").write_text("name,release,fp32_flops,memory_bytes,extra\nAX 100,2017-06-01,1000000000000,16000000000,z\nAX  100,May 2017,2000000000000,,z\nA/B,2017,1,1,z\nNo Date,,1,1,z\n")
    rows = specs.merge_variants(specs.read_sheet(spark, str(tmp_path / "s.csv"))).collect()
    assert [(r["id"], r["release"], r["fp32_gflops"], r["vram_gb"], r["tdp_w"]) for r in rows] == [("ax-100", "2017-05", 2000.0, 16.0, None)]
    known = spark.createDataFrame([("ax-100",)], "id string")
    assert specs.merge_variants(specs.read_sheet(spark, str(tmp_path / "s.csv")), known).count() == 0
