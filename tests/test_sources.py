from __future__ import annotations

import gzip
import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from quern.corpus import get_corpus, latest_version, pending
from quern.operators import extract
from quern.sources import archives, metadata, records
from quern.streaming import ingest


def gz(data: bytes) -> bytes:
    return gzip.compress(data)


def tar_of(files: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for name, data in files.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


@pytest.mark.parametrize(
    ("data", "reason"),
    [(b"", "corrupt"), (b"%PDF-1.4", "pdf_only"), (b"%!PS", "postscript"), (b"plain", "not_gzip"), (gz(b"%PDF"), "pdf_only"), (gz(b"  "), ""), (gz(b"x")[:-6], "corrupt"), (gz(tar_of({"a.bbl": b"x"})), "no_tex"), (gz(b"\\doc"), "")],
)
def test_unpack(data, reason):
    assert archives.unpack("a.gz", data)[1] == reason


def old_tar(files: dict[str, bytes]) -> bytes:
    """Without the mark of later formats; checksums count the mark as blanks do."""
    data = bytearray(tar_of(files))
    at = 0
    for content in files.values():
        data[at + 257 : at + 265] = b"\0" * 8
        data[at + 148 : at + 156] = b" " * 8
        data[at + 148 : at + 156] = b"%06o\0 " % sum(data[at : at + 512])
        at += 512 + -(-len(content) // 512) * 512
    return bytes(data)


def test_unpack_of_plain_files():
    assert archives.unpack("0704/x.tex", b"\\documentclass...") == ({"x.tex": b"\\documentclass..."}, "")
    assert archives.unpack("0704/x.gz", gz(b"Hello")) == ({"x.tex": b"Hello"}, "")
    inner = {"m.tex": b"A", "x.bbl": b"B", "README": b"C", "s.sty": b"D"}
    for data in (tar_of(inner), gz(tar_of(inner)), gz(old_tar(inner))):
        assert archives.unpack("a/1.gz", data) == ({"m.tex": b"A", "s.sty": b"D"}, "")
    assert archives.unpack("x.gz", gz(tar_of({"fig.eps": b"%!PS"}))) == ({}, "no_tex")
    assert [archives.content_kind(*x) for x in (("paper.tex", b"%PDF-1.4"), ("a", b"\x1f\x8b\x08"), ("paper.tex", b"x"), ("m.dat", b"\0\1"))] == ["pdf", "gzip", "text", "unknown"]


def test_assemble():
    source, stats = archives.assemble({"b.tex": b"short", "a.tex": rb"x\begin{document}longer body\end{document}y", "c.sty": b"no", "l.tex": "caf\xe9".encode("latin-1")})
    assert source == "longer body\n\nshort\n\ncafé"
    assert stats == {"n_files": 4, "encoding": "utf-8", "body_found": True}


def test_tar_to_submissions(spark, tmp_path):
    (tmp_path / "arXiv_src_0704_001.tar").write_bytes(tar_of({"0704/0704.0001.gz": gz(b"\\begin{document}Hello\\end{document}"), "0704/0704.0002.pdf": b"%PDF-1", "0704/readme": b"x", "0704/hep-th0001001.gz": gz(tar_of({"m.tex": b"A", "x.bbl": b"B"}))}))
    got = {r["member"]: r for r in archives.read_submissions(spark, str(tmp_path)).collect()}
    assert got["0704/0704.0001.gz"]["source"] == "Hello" and got["0704/0704.0001.gz"]["paper_id"] == "arxiv:0704.0001"
    assert got["0704/0704.0002.pdf"]["skip_reason"] == "pdf_only"
    assert got["0704/readme"]["skip_reason"] == "unknown_id"
    assert (got["0704/hep-th0001001.gz"]["source"], got["0704/hep-th0001001.gz"]["year"]) == ("A", 2000)


def test_manifest(spark, tmp_path):
    row = "<file><filename>{}</filename><yymm>{}</yymm><num_items>{}</num_items><size>{}</size></file>"
    rows = [("b.tar", "0001", 5, 10), ("a.tar", "9912", 5, 20), ("c.tar", "1001", "x", 5), ("", "1002", 1, 1)]
    text = "<m>" + "".join(row.format(*r) for r in rows).replace("<filename></filename>", "") + "</m>"
    (tmp_path / "m.xml").write_text(text)
    m = archives.read_manifest(spark, str(tmp_path / "m.xml"))
    assert [r["filename"] for r in m.collect()] == ["a.tar", "b.tar"]
    assert [r["filename"] for r in archives.select_archives(m, (1999, 1), (1999, 12)).collect()] == ["a.tar"]
    assert archives.transfer_cost(10**9, False) == pytest.approx(0.09) and archives.transfer_cost(5, True) == 0


def test_records(spark, tmp_path):
    text = "Heading\nFirst paragraph, which is long enough to stay here.\nshort\nSecond paragraph that is long enough as well."
    first, second = text.index("First"), text.index("Second")
    spans = json.dumps([{"start": second, "end": len(text)}, {"start": first, "end": first + 52}, {"start": 61, "end": 66}])
    rows = [{"corpusid": 1, "body": {"text": text, "annotations": {"paragraph": spans, "section_header": '[{"start": 0, "end": 7}]'}}}, {"corpusid": 2, "body": {"text": "A first one without any spans at all.\n\nno\n\nAnd another one without any spans.", "annotations": None}}, {"corpusid": 3, "body": None}]
    with gzip.open(tmp_path / "r.jsonl.gz", "wt") as f:
        f.write("\n".join([*map(json.dumps, rows), "{broken"]))
    read = records.read_records(spark, str(tmp_path / "r.jsonl.gz"))
    got = sorted((r["paper_id"], r["idx"], r["section"]) for r in records.record_paragraphs(read).select("paper_id", "idx", "section").collect() if True)
    assert [g[:2] for g in got] == [("1", 0), ("1", 2), ("2", 0), ("2", 2)] or [g[:2] for g in got] == [("1", 0), ("1", 1), ("2", 0), ("2", 2)]
    assert got[0][2] == "Heading"
    assert {r["paper_id"]: r["body_chars"] for r in records.record_papers(read).collect()}["3"] == 0


def test_metadata(spark, tmp_path):
    rows = [{"id": "2301.00001", "categories": "hep-th math.GT", "title": " A\n  b", "abstract": "", "versions": [{"version": "v1", "created": "Mon, 2 Jan 2023 10:00:00 GMT"}]}, {"id": "hep-th/9901001", "categories": "zz.X", "versions": [{"version": "v1", "created": "bad"}]}]
    (tmp_path / "s.json").write_text("\n".join(map(json.dumps, rows)))
    got = {r["source_id"]: r for r in metadata.normalise(metadata.read_snapshot(spark, str(tmp_path / "s.json")), {"hep-th": "Physics"}).collect()}
    a, b = got["2301.00001"], got["hep-th/9901001"]
    assert (a["field"], a["title"], a["abstract"], str(a["submitted"]), a["year"], a["n_versions"]) == ("Physics", "A b", None, "2023-01-02", 2023, 1)
    assert (b["field"], b["submitted"], b["year"]) == (None, None, 1999)


def test_answers(spark):
    good = {"model_raw": "AX 100", "model_normalized": None, "manufacturer": "nvidia", "accelerator_subtype": "tpu", "device_count": 99999999999, "device_count_basis": "explicit", "memory_gb": 32, "usage_context": "used-in-this-work", "evidence_quote": "q", "more": 1}
    answer = lambda **more: json.dumps({"mentions": [good | more]})
    broken = [answer(usage_context="used_in_this_work"), answer(manufacturer="NVIDIA"), answer(manufacturer=None), answer(device_count=1.5), answer(device_count_basis="guessed"), answer(memory_gb="much"), json.dumps({"mentions": [{k: v for k, v in good.items() if k != "memory_gb"}]}), '{"mentions": [1]}', "[]"]
    rows = [(1, '{"mentions": []}', False), (2, "{", False), (3, answer(), False), (4, "{}", True), (5, None, False), (6, "{}", False), (7, answer(device_count=None, device_count_basis=None, memory_gb=None), False)] + [(10 + k, x, False) for k, x in enumerate(broken)]
    parsed = extract.parse_answers(spark.createDataFrame(rows, "k int, raw string, cut boolean"), "raw", "cut")
    assert {r["k"]: r["status"] for r in parsed.collect()} == {1: "no_mention", 2: "json_error", 3: "ok", 4: "truncated", 5: "json_error", 6: "json_error", 7: "ok"} | {10 + k: "json_error" for k in range(len(broken))}
    out = {r["k"]: r for r in extract.mention_rows(parsed, "k").collect()}
    assert len(out) == 7 + len(broken) and out[3]["device_count"] == 2147483647 and out[1]["model_raw"] is None
    assert (out[3]["device_count_basis"], out[3]["memory_gb"], out[7]["device_count"]) == ("explicit", 32.0, None)
    # The stages in a row: answers, canonical models, capacity.
    from quern.operators import capacity, matching
    from tests.test_matching import LEXICON

    asked = parsed.withColumn("paper_id", F.concat(F.lit("p"), F.col("k") % 2))
    resolved = matching.canonicalise(extract.mention_rows(asked, "k", "paper_id"), "model_raw", LEXICON)
    years = spark.createDataFrame([("p1", 2020)], "paper_id string, year int")
    specs = spark.createDataFrame([("ax100", 2017, 10.0, None, 5.0, 16.0, 300.0, "x")], "model string, release_year int, fp32 double, fp64 double, tensor double, vram_gb double, tdp double, segment string")
    papers = {policy: capacity.paper_capacity(capacity.per_model(capacity.winsorised(capacity.used_models(resolved, years), policy), specs)).collect() for policy in ("floor1", "explicit")}
    assert [(r["paper"], r["max_devices"], r["reported_fp32"], r["reported_vram"]) for r in papers["floor1"]] == [("p1", 65536.0, 655360.0, 32.0 * 65536)]
    assert len(papers["explicit"]) == 1
    assert capacity.winsorised(capacity.used_models(resolved, years), "explicit").count() == 1


def test_repacked_shards_are_full(spark):
    from quern.operators.repack import shard_rows

    rows = spark.range(0, 200_000, 1, 8).select(F.xxhash64("id").alias("k"), F.concat(F.lit("text "), "id").alias("text"), F.repeat(F.lit("x"), 40).alias("more"))
    got = shard_rows(rows, ["k"], 2500, ranges=64)
    counts = {r["shard"]: (r["n"], r["least"], r["most"]) for r in got.groupBy("shard").agg(F.count("*").alias("n"), F.min("k").alias("least"), F.max("k").alias("most"), F.max("text")).collect()}
    assert [counts[s][0] for s in range(80)] == [2500] * 80 and all(counts[s][2] < counts[s + 1][1] for s in range(79))


def test_shards_of_ties_do_not_depend_on_arrival(spark):
    from quern.operators.repack import shard_rows

    rows = spark.range(0, 1000, 1, 4).select((F.col("id") % 7).alias("k"), (F.xxhash64("id") % 50).alias("x"))
    made = [shard_rows(df, ["k"], 90, ranges=2).groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("rows")).collect() for df in (rows.coalesce(1), rows.orderBy(F.desc("x")).coalesce(1), rows.orderBy("x").coalesce(1))]
    assert sorted(made[0]) == sorted(made[1]) == sorted(made[2])


def test_versions_and_ledger(spark, tmp_path):
    corpus = get_corpus("arxiv")
    for v in ("0.9.0", "0.10.0"):
        spark.range(1).write.parquet(corpus.path(str(tmp_path), "candidates", registry_version=v))
    assert latest_version(spark, str(tmp_path), "candidates", corpus) == "0.10.0"
    with pytest.raises(ValueError, match="several"):
        latest_version(spark, str(tmp_path), "candidates", corpus, unique=True)
    with pytest.raises(FileNotFoundError):
        latest_version(spark, str(tmp_path), "mentions", corpus)
    with pytest.raises(ValueError, match="unknown corpus"):
        get_corpus("x")
    asked = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "2")], "shard string, md5 string")
    done = spark.createDataFrame([("a", "1"), ("c", "1")], "shard string, md5 string")
    assert sorted(r["shard"] for r in pending(asked, done, ["shard", "md5"]).collect()) == ["b", "c"]


def test_ingest_takes_each_file_once(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    spark.range(5).coalesce(1).write.parquet(src)
    assert ingest.ingest_new(spark, src, "id bigint", out, mark) == 5
    assert ingest.ingest_new(spark, src, "id bigint", out, mark) == 5
    spark.range(3).coalesce(1).write.mode("append").parquet(src)
    assert ingest.ingest_new(spark, src, "id bigint", out, mark) == 8
