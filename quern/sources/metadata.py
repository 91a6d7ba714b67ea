"""Paper metadata snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quern.functions import text as tx

SNAPSHOT = "id string, categories string, title string, abstract string, versions array<struct<version:string,created:string>>, license string, doi string, `journal-ref` string"


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines or a folder of Parquet, eight columns only."""
    if ".json" in path:
        return spark.read.schema(SNAPSHOT).option("mode", "DROPMALFORMED").json(path)
    return spark.read.schema(SNAPSHOT).parquet(path)


def normalise(snapshot: DataFrame, taxonomy: dict[str, str]) -> DataFrame:
    """One row per paper: collapsed texts, category and field, date of the first version.

    A date that does not parse is null, an unknown archive has a null field, empty texts are null.
    """
    dim = snapshot.sparkSession.createDataFrame(sorted(taxonomy.items()), "archive string, field string")
    primary = F.get(F.split(F.col("categories"), " "), F.lit(0))
    created = F.regexp_extract(F.get(F.col("versions"), F.lit(0))["created"], r"(\d{1,2} [A-Z][a-z]{2} \d{4} \d{2}:\d{2}:\d{2})", 1)
    empty = lambda c: F.nullif(tx.collapse(c), F.lit(""))
    rows = snapshot.where(F.coalesce("id", F.lit("")) != "").select(
        tx.paper_key(F.col("id")).alias("paper_id"), F.col("id").alias("source_id"), primary.alias("primary_category"), F.split("categories", " ").alias("categories"), tx.archive_of(primary).alias("archive"), empty(F.col("title")).alias("title"), empty(F.col("abstract")).alias("abstract"),
        F.try_to_timestamp(created, F.lit("d MMM yyyy HH:mm:ss")).cast("date").alias("submitted"), tx.id_year(F.col("id")).alias("year"), tx.id_month(F.col("id")).alias("month"), F.coalesce(F.size("versions"), F.lit(0)).alias("n_versions"), empty(F.col("license")).alias("license"), empty(F.col("doi")).alias("doi"), empty(F.col("journal-ref")).alias("journal_ref"),
    )
    return rows.join(F.broadcast(dim), "archive", "left")


def audit(snapshot: DataFrame, papers: DataFrame) -> dict[str, DataFrame]:
    """What a snapshot lost: ``bad`` rows without an id (one row), ``unmapped`` archives without a field
    with their papers, and ``agreement`` (one row): shares with field and abstract, and how often the year
    of the id is that of the first version, among papers with both."""
    both = F.when(F.col("year").isNotNull() & F.col("submitted").isNotNull(), (F.col("year") == F.year("submitted")).cast("int"))
    share = lambda c: F.avg(F.col(c).isNotNull().cast("int")).alias(f"{c}_share")
    return {
        "bad": snapshot.agg(F.count_if(F.coalesce("id", F.lit("")) == "").alias("bad")),
        "unmapped": papers.where("field is null").groupBy("archive").agg(F.count("*").alias("n")),
        "agreement": papers.agg(F.count("*").alias("n"), share("field"), share("abstract"), F.avg(both).alias("year_agreement")),
    }
