"""Command line: python -m quern COMMAND ..."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession, functions as F

from quern.checkpoint import checkpointed
from quern.corpus import CORPORA, get_corpus
from quern.functions.text import latex_paragraphs
from quern.operators import encode, extract, matching, panels, topics
from quern.operators.lexicon import load_lexicon, load_taxonomy
from quern.operators.repack import shard_rows
from quern.sources import archives, metadata, records
from quern.streaming.chunks import run_missing, write_parameters


def _scan(spark: SparkSession, a: argparse.Namespace) -> None:
    lexicon = load_lexicon(a.lexicon, a.generated)
    read = records.read_records(spark, a.input, a.limit)
    inventory, candidates = matching.scan_papers(records.record_papers(read), records.record_paragraphs(read), lexicon)
    inventory.write.mode("overwrite").parquet(f"{a.out}/inventory")
    candidates.write.mode("overwrite").parquet(f"{a.out}/candidates/registry_version={lexicon.version}")


def _scan_archives(spark: SparkSession, a: argparse.Namespace) -> None:
    lexicon = load_lexicon(a.lexicon, a.generated)
    submissions = archives.read_submissions(spark, a.input)
    # Written first: the archives are unpacked once, whatever is made of them.
    submissions.write.mode("overwrite").parquet(f"{a.out}/submissions")
    read = spark.read.parquet(f"{a.out}/submissions")
    sources = read.where("skip_reason = ''").select("paper_id", "source")
    papers = sources.select("paper_id", F.length("source").alias("body_chars"))
    paragraphs = latex_paragraphs(sources, "paper_id", "source").select("paper_id", "idx", "text", "section")
    inventory, candidates = matching.scan_papers(papers, paragraphs, lexicon)
    read.drop("source").write.mode("overwrite").parquet(f"{a.out}/ingest")
    inventory.write.mode("overwrite").parquet(f"{a.out}/inventory")
    candidates.write.mode("overwrite").parquet(f"{a.out}/candidates/registry_version={lexicon.version}")


def _repack(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = shard_rows(spark.read.parquet(a.input), ["paper_id", "para_idx"], a.shard_size)
    rows.write.mode("overwrite").partitionBy("shard").parquet(f"{a.out}/passages")
    written = spark.read.parquet(f"{a.out}/passages")
    written.groupBy("shard").agg(F.count("*").alias("n_passages"), F.countDistinct("paper_id").alias("n_papers")).write.mode("overwrite").parquet(f"{a.out}/manifest")


def _extract(spark: SparkSession, a: argparse.Namespace) -> None:
    passages = spark.read.parquet(a.input)
    answers = extract.extract(passages, "passage_id", "passage_text", extract.rule_extractor(a.pattern))
    rows = extract.mention_rows(extract.parse_answers(answers, "raw_json", "truncated"), "passage_id")
    paper = F.regexp_extract("passage_id", r"(?s)^(.*):\d+$", 1)
    panels.stamped(rows.withColumn("paper_id", paper), extractor="rules", pattern=a.pattern).write.mode("overwrite").parquet(a.out)


def _compute(spark: SparkSession, a: argparse.Namespace) -> None:
    lexicon = load_lexicon(a.lexicon, a.generated)
    made = panels.reported_capacity(get_corpus(a.corpus), spark.read.parquet(a.input), spark.read.parquet(a.metadata), lexicon, a.policy, a.mentions_version)
    made.write.mode("overwrite").parquet(a.out)
    known = spark.read.parquet(a.out).agg(F.count("*").alias("papers"), *[F.count_if(~F.col(c)).alias(c[13:]) for c in made.columns if c.startswith("spec_missing_")]).first()
    print(", ".join(f"{k}: {v}" for k, v in known.asDict().items()))


def _denominator(spark: SparkSession, a: argparse.Namespace) -> None:
    corpus, lexicon = get_corpus(a.corpus), load_lexicon(a.lexicon, a.generated)
    panels.denominator(corpus, spark.read.parquet(a.input), spark.read.parquet(a.metadata)).write.mode("overwrite").parquet(f"{a.out}/denominator")
    panels.flags(corpus, spark.read.parquet(a.mentions), lexicon).write.mode("overwrite").parquet(f"{a.out}/paper_flags")
    if a.outcomes and corpus.citations:
        focal = spark.read.parquet(f"{a.out}/denominator").join(spark.read.parquet(f"{a.out}/paper_flags").select(corpus.key), corpus.key, "left_semi")
        panels.citations(corpus, focal, spark.read.parquet(a.outcomes)).write.mode("overwrite").parquet(f"{a.out}/citations")


def _embed(spark: SparkSession, a: argparse.Namespace) -> None:
    corpus = get_corpus(a.corpus)
    about = panels.keyed(corpus, spark.read.parquet(a.metadata))
    work = encode.worklist(panels.keyed(corpus, spark.read.parquet(a.input)), about, about, corpus.key)
    # Written first: every group of chunks reads it again.
    work.write.mode("overwrite").parquet(f"{a.out}/work")
    ran = run_missing(spark.read.parquet(f"{a.out}/work"), corpus.key, a.chunks, a.out, lambda rows: encode.encode(rows, corpus.key, encode.hashing_encoder(a.size), a.size))
    print(f"{ran} of {a.chunks} chunks made")


def _cluster(spark: SparkSession, a: argparse.Namespace) -> None:
    corpus = get_corpus(a.corpus)
    rows = encode.aligned(spark.read.parquet(a.input), panels.keyed(corpus, spark.read.parquet(a.metadata)), corpus.key)
    vectors = checkpointed(rows)
    fitted = checkpointed(vectors.join(topics.density_clusters(vectors, corpus.key, "embedding", a.clusters), corpus.key))
    if a.reduce_outliers:
        assigned = topics.reassign_outliers(fitted, corpus.key, "topic_id", "embedding")
    else:
        assigned = fitted.select(corpus.key, "topic_id", F.lit(False).alias("was_outlier"))
    assigned.write.mode("overwrite").parquet(f"{a.out}/assignments")
    assigned = spark.read.parquet(f"{a.out}/assignments")
    placed = assigned.where("topic_id is not null")
    words = topics.class_keywords(placed.join(vectors, corpus.key), "topic_id", "text", a.least_docs)
    listed = words.groupBy("topic_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), ", ").alias("keywords"))
    topics.representatives(placed, corpus.key).join(listed, "topic_id", "left").write.mode("overwrite").parquet(f"{a.out}/topics")
    noise = fitted.agg(F.count("*").alias("n"), F.count_if(F.col("topic_id").isNull()).alias("noise")).first()
    write_parameters(spark, f"{a.out}/params", {"clusters": a.clusters, "reduce_outliers": a.reduce_outliers, "least_docs": a.least_docs, "papers": noise["n"], "fit_noise": noise["noise"]})


def _precision(spark: SparkSession, a: argparse.Namespace) -> None:
    matching.pattern_flags(spark.read.parquet(a.input), "paper_id", "passage_text").write.mode("overwrite").parquet(a.out)


def _metadata(spark: SparkSession, a: argparse.Namespace) -> None:
    metadata.normalise(metadata.read_snapshot(spark, a.input), load_taxonomy(a.taxonomy)).write.mode("overwrite").parquet(a.out)


def _manifest(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = archives.read_manifest(spark, a.input)
    rows.write.mode("overwrite").parquet(a.out)
    total = rows.agg(F.sum("size")).first()[0] or 0
    print(f"{rows.count()} archives, {total} bytes, {archives.transfer_cost(total, a.same_region):.2f} USD to read")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quern")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, run, help: str) -> argparse.ArgumentParser:
        s = sub.add_parser(name, help=help)
        s.add_argument("--input", required=True)
        s.add_argument("--out", required=True)
        s.set_defaults(run=run)
        return s

    for name, run, help in (("scan", _scan, "JSON-line records to inventory and candidates"), ("scan-archives", _scan_archives, "LaTeX archives to inventory, candidates and ingest statistics")):
        s = add(name, run, help)
        s.add_argument("--lexicon", required=True)
        s.add_argument("--generated", nargs="*", default=[])
        s.add_argument("--limit", type=int)
    add("repack", _repack, "candidates to equal shards with a manifest").add_argument("--shard-size", type=int, default=25_000)
    add("extract", _extract, "passages to mentions").add_argument("--pattern", required=True)
    for name, run, help in (("compute", _compute, "mentions to reported capacity per paper"), ("denominator", _denominator, "an inventory to population, flags and citations")):
        s = add(name, run, help)
        s.add_argument("--lexicon", required=True)
        s.add_argument("--generated", nargs="*", default=[])
        if name == "compute":
            s.add_argument("--policy", choices=("floor1", "explicit"), default="floor1")
            s.add_argument("--mentions-version")
        else:
            s.add_argument("--mentions", required=True)
            s.add_argument("--outcomes")
    s = add("embed", _embed, "papers with mentions to embeddings, chunk by chunk")
    s.add_argument("--chunks", type=int, default=64)
    s.add_argument("--size", type=int, default=256)
    s = add("cluster", _cluster, "embeddings to topics")
    s.add_argument("--clusters", type=int, default=8)
    s.add_argument("--least-docs", type=int, default=10)
    s.add_argument("--reduce-outliers", action="store_true")
    for name in ("compute", "denominator", "embed", "cluster"):
        sub.choices[name].add_argument("--metadata", required=True)
        sub.choices[name].add_argument("--corpus", choices=sorted(CORPORA), default="arxiv")
    add("precision", _precision, "candidates to flags of numeric formats")
    add("metadata", _metadata, "a snapshot to paper metadata").add_argument("--taxonomy", required=True)
    add("manifest", _manifest, "an XML manifest to a table, with its cost").add_argument("--same-region", action="store_true")
    return p


def main(argv: list[str]) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"quern {args.command}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    args.run(spark, args)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
