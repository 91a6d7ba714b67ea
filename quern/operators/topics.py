"""Topics over embeddings: centroids, reassignment of outliers, key words, density clusters."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from quern.checkpoint import checkpointed


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def centroids(vectors: DataFrame, topic: str, vector: str) -> DataFrame:
    """(topic, centroid): the mean vector of each topic, combined before the shuffle."""
    parts = vectors.where(F.col(topic).isNotNull()).select(topic, F.posexplode(vector).alias("k", "x"))
    means = parts.groupBy(topic, "k").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy(topic).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("centroid"))


#: Values of all centroids that are sent to every task as one array at most: 64 MB.
MOST_VALUES = 1 << 23


def reassign_outliers(vectors: DataFrame, key: str, topic: str, vector: str) -> DataFrame:
    """(key, topic_id, was_outlier): vectors without a topic go to the one whose centroid has the highest
    cosine (ties: the lower topic).

    The centroids go to all tasks as one array where they are few; beyond MOST_VALUES numbers they are cut
    into arrays of that size, and the best of each array is combined before the shuffle."""
    table = centroids(vectors, topic, vector)
    values = table.agg(F.sum(F.size("centroid"))).first()[0] or 0
    cut = -(-values // MOST_VALUES) or 1
    entry = F.struct(F.col(topic).alias("t"), "centroid")
    tables = table.groupBy(F.pmod(F.xxhash64(topic), F.lit(cut)).alias("part")).agg(F.array_sort(F.collect_list(entry)).alias("table"))
    outliers = vectors.where(F.col(topic).isNull()).select(key, vector)
    best = lambda t: F.array_max(F.transform(t, lambda c: F.struct(F.round(cosine(F.col(vector), c["centroid"]), 12).alias("s"), (-c["t"]).alias("t"))))
    if cut == 1:
        nearest = outliers.join(F.broadcast(tables)).select(key, -best(F.col("table"))["t"])
    else:
        nearest = None
        for part in range(cut):
            scored = outliers.join(F.broadcast(tables.where(F.col("part") == part))).select(key, best(F.col("table")).alias("b"))
            nearest = scored if nearest is None else nearest.union(scored)
        nearest = nearest.groupBy(key).agg((-F.max("b")["t"]).alias("t"))
    placed = vectors.where(F.col(topic).isNotNull()).select(key, F.col(topic).alias("topic_id"), F.lit(False).alias("was_outlier"))
    return placed.union(nearest.toDF(key, "topic_id").withColumn("was_outlier", F.lit(True)))


def representatives(assigned: DataFrame, key: str, n: int = 5) -> DataFrame:
    """(topic_id, size, rep_keys): the first ``n`` keys of each topic, taken per part of it first."""
    part = F.pmod(F.xxhash64(key), F.lit(256))
    first = assigned.withColumn("part", part).withColumn("r", F.row_number().over(Window.partitionBy("topic_id", "part").orderBy(key))).where(F.col("r") <= n)
    reps = first.groupBy("topic_id").agg(F.slice(F.array_sort(F.collect_list(key)), 1, n).alias("rep_keys"))
    return assigned.groupBy("topic_id").agg(F.count("*").alias("size")).join(reps, "topic_id")


#: Bytes of documents whose terms meet in one task, tasks at most, and different terms that a worker holds.
BYTES_PER_TASK, MOST_TASKS, TERMS_AT_ONCE = 16 << 20, 2000, 300_000


def _term_counts(docs: DataFrame, stop: tuple[str, ...]) -> DataFrame:
    """(topic, term, tf, df) of documents (topic, text in small letters): words and pairs of words, counted over
    runs of documents; a term has a row per run."""
    topic, ignored = docs.columns[0], frozenset(stop)
    word = re.compile("[a-z]{2,}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict = {}
        kind = None

        def flushed() -> Iterator[pa.RecordBatch]:
            for name, (tf, df) in tables.items():
                terms, counts = list(tf), list(tf.values())
                for at in range(0, len(terms), 50_000):
                    part = terms[at : at + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part), kind), pa.array(part, pa.string()), pa.array(counts[at : at + 50_000], pa.int64()), pa.array([df[t] for t in part], pa.int64())], names=[topic, "term", "tf", "df"])
            tables.clear()

        for batch in batches:
            kind = batch.schema.field(0).type
            for at in range(batch.num_rows):
                text = batch.column(1)[at].as_py()
                if text is None:
                    continue
                words = word.findall(text)
                if ignored:
                    words = [w for w in words if w not in ignored]
                words += [f"{a} {b}" for a, b in pairwise(words)]
                name = batch.column(0)[at].as_py()
                tf, df = tables.setdefault(name, (Counter(), Counter()))
                tf.update(words)
                df.update(set(words))
                if sum(len(t) for t, _ in tables.values()) >= TERMS_AT_ONCE:
                    yield from flushed()
        yield from flushed()

    return docs.mapInArrow(run, StructType([docs.schema[0], *StructType.fromDDL("term string, tf bigint, df bigint").fields]))


def class_keywords(docs: DataFrame, topic: str, text: str, least_docs: int = 10, top: int = 10, stop: tuple[str, ...] = ()) -> DataFrame:
    """(topic, rank, term, score): class-based TF-IDF over words and pairs of words.

    Score: the count in the topic over all of its terms, times log(1 + mean terms per topic over the
    count in all topics).  Terms in fewer than ``least_docs`` documents go.
    """
    counted = _term_counts(docs.select(topic, F.lower(text).alias("text")), stop)
    # By term alone: what a term has in all topics is then known where its topics are added up.
    spark = docs.sparkSession
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // BYTES_PER_TASK
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(size, MOST_TASKS))
    summed = counted.repartition(tasks, "term").groupBy(topic, "term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
    every = Window.partitionBy("term")
    common = summed.withColumn("f", F.sum("tf").over(every)).withColumn("docs", F.sum("df").over(every)).where(F.col("docs") >= least_docs)
    # Written once: the sizes, their mean and the scores read it.
    counts = checkpointed(common.select(topic, "term", "tf", "f"))
    sizes = counts.groupBy(topic).agg(F.sum("tf").alias("all"))
    mean = sizes.agg(F.avg("all").alias("mean"))
    scored = counts.join(sizes, topic).join(F.broadcast(mean)).withColumn("score", F.col("tf") / F.col("all") * F.ln(1 + F.col("mean") / F.col("f")))
    # The first of every part of a topic, then the first of these.
    best = [F.desc(F.round("score", 10)), F.col("term")]
    parts = scored.withColumn("part", F.pmod(F.xxhash64("term"), F.lit(64)))
    first = parts.withColumn("r", F.row_number().over(Window.partitionBy(topic, "part").orderBy(*best))).where(F.col("r") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy(topic).orderBy(*best)))
    return ranked.where(F.col("rank") <= top).select(topic, "rank", "term", "score")


def density_clusters(vectors: DataFrame, key: str, vector: str, k: int = 8, core_share: float = 0.75, seed: int = 42) -> DataFrame:
    """(key, topic_id): a substitute for manifold projection and density clustering.

    Principal components, k-means in them, and the outer quarter of every cluster as noise (null).
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    made = vectors.withColumn("v", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    low = PCA(k=5, inputCol="v", outputCol="p").fit(made).transform(made)
    model = KMeans(k=k, seed=seed, featuresCol="p", predictionCol="c").fit(low)
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in model.clusterCenters()])
    placed = model.transform(low).withColumn("far", F.aggregate(F.zip_with(vector_to_array("p"), F.get(centres, F.col("c")), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    edge = placed.groupBy("c").agg(F.percentile_approx("far", core_share).alias("edge"))
    return placed.join(F.broadcast(edge), "c").select(key, F.when(F.col("far") <= F.col("edge"), F.col("c")).alias("topic_id"))
