from __future__ import annotations

import random

import corpus_pipeline
from quern.llm import byte_bpe


def test_pipeline(spark, tmp_path):
    rng = random.Random(4)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passage = text(60)
    clean = [f"{text(60)}\n{text(40)}" for _ in range(30)]
    texts = clean + [clean[0], clean[1].replace("w", "v", 1), f"{text(70)}\n{passage}", f"{text(70)}\n{passage}", "bad", None]
    rows = [(k, t, "en", f"s{k % 2}", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert out.columns == docs.columns
        docs, seen[name] = out, out.collect()
    assert sorted(r["doc_id"] for r in seen["quality"]) == list(range(34))
    assert {r["doc_id"]: r["text"] for r in seen["lines"]}[33].count("\n") == 0 and all(r["n_chars"] == len(r["text"]) for r in seen["lines"])
    kept = {r["doc_id"] for r in seen["near_copies"]}
    assert set(range(30)) <= kept and 30 not in kept
    decoded = byte_bpe.decode_documents(docs.select("doc_id", "ids")).collect()
    assert sorted((r["doc_id"], bytes(r["content"]).decode()) for r in decoded) == sorted((r["doc_id"], r["text"]) for r in seen["mixture"])
    final = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r["doc_id"], r["ids"]) for r in final.collect()) == sorted((r["doc_id"], r["ids"]) for r in seen["tokens"])


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
