"""Near-duplicate vectors: spherical k-means cells and blocked cosine products.

Centres are fitted on a bounded sample; they decide what the join costs, not what it finds.  A vector
lives in the cell of its nearest centre and visits every other cell whose bisector with its own lies
within half of the threshold angle: of two vectors within that angle that live in different cells, at
least one is that near to the bisector, so every link is seen in some cell.  Inside a cell, those who
live there and those who visit are dealt into blocks of bounded size, and each pair of blocks with one
of inhabitants is one matrix product: visitors never meet.  A product returns
link counts per row and the edges of a spanning forest, never all its pairs.

Equal vectors of one label are one node with a count, so exact copies are never multiplied.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quern.llm.graph import components
from quern.llm.simhash import _forest
from quern.llm.storage import materialize

THRESHOLD = 0.93
#: Vectors that the centres are fitted on: so many to a cell, within these bounds.
SAMPLE_PER_CELL, LEAST_SAMPLE, MOST_SAMPLE = 64, 4096, 65_536
#: Nodes to a cell, about, and cells at most.
CELL_NODES = 4096
MOST_CELLS = 1024
#: Rows of one side of a product.
BLOCK_ROWS = 1024


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    x = vectors.astype(np.float64)
    # Scaled first: squares of large or tiny components neither overflow nor vanish.
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit_centres(unit: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Spherical k-means: unit centres, by cosine."""
    rng = np.random.default_rng(seed)
    centres = unit[rng.choice(len(unit), min(k, len(unit)), replace=False)]
    for _ in range(rounds):
        home = np.concatenate([(unit[at : at + 4096] @ centres.T).argmax(axis=1) for at in range(0, len(unit), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, home, unit)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 1e-12, sums / np.maximum(norms, 1e-12), centres)
    return np.unique(centres, axis=0)


def margins(centres: np.ndarray, threshold: float) -> np.ndarray:
    """How much nearer to its own centre than to another a vector may be and still visit the other: the
    distance of the centres times the sine of half of the threshold angle."""
    gaps = np.sqrt(np.maximum(2 - 2 * (centres @ centres.T), 0))
    return gaps * math.sin(math.acos(threshold) / 2) + 1e-7


def cells_of(unit: np.ndarray, centres: np.ndarray, within: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(home cell, matrix of visited cells) of unit rows."""
    dots = unit @ centres.T
    home = dots.argmax(axis=1)
    visits = np.take_along_axis(dots, home[:, None], 1) - dots <= within[home]
    visits[np.arange(len(unit)), home] = False
    return home, visits


def vector_links(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """One row per vector: (id, n_links long, component_id, kept boolean).

    Vectors of one label and length link when their cosine, in double precision, is at least
    ``threshold`` (above 0).  Null labels, null or empty vectors, zero vectors and vectors with null or
    non-finite components link with nothing: 0 links, a component of their own.  ``n_links`` counts the
    other rows that link directly, copies included; ``component_id`` is the least id that links reach.
    Repeated rows count as vectors of their own; a null id is no component_id beside other ids.
    """
    spark = vectors.sparkSession
    ok = F.col("label").isNotNull() & (F.size("vec") > 0) & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    # Adding zero makes -0.0 and 0.0 one value.
    rows = vectors.select(vectors[id_col].alias("id"), vectors[label_col].alias("label"), F.transform(vectors[vector_col], lambda x: x + F.lit(0).cast("float")).alias("vec")).withColumn("ok", F.coalesce(ok, F.lit(False))).withColumn("h", F.xxhash64("vec"))
    rows = materialize(rows, "vectors")
    nodes = materialize(rows.where("ok").groupBy("label", "h", "vec").agg(F.min("id").alias("least_id"), F.count("*").alias("copies")).withColumn("node", F.monotonically_increasing_id()), "vector-nodes")
    centres = _centres(nodes)
    edges_and_counts = materialize(_products(nodes, centres, threshold), "vector-links")
    counts = edges_and_counts.where("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    found = components(edges_and_counts.where("b is not null").select("a", "b"), "a", "b")
    of_node = nodes.select("node", "label", "h", "vec", "least_id", "copies").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = of_node.groupBy("component").agg(F.min("least_id").alias("component_id"))
    table = of_node.join(least, "component").join(counts, of_node["node"] == counts["a"], "left").select("label", "h", "vec", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    linked = rows.where("ok").join(table, ["label", "h", "vec"]).select("id", "n_links", "component_id")
    alone = rows.where("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def representatives(vectors: DataFrame, links: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """The rows of ``vectors`` that ``vector_links`` keeps: one id of every component."""
    return vectors.join(links.where("kept").select(id_col).distinct(), id_col, "left_semi")


def _centres(nodes: DataFrame) -> dict[int, np.ndarray]:
    """Centres for every length of vector, fitted on at most MOST_SAMPLE vectors of that length."""
    found = {}
    for length, n in ((r[0], r[1]) for r in nodes.groupBy(F.size("vec")).count().collect()):
        k = int(min(MOST_CELLS, max(1, n // CELL_NODES)))
        if k == 1:
            found[length] = np.eye(1, length)
            continue
        rows = min(MOST_SAMPLE, max(LEAST_SAMPLE, SAMPLE_PER_CELL * k))
        sample = nodes.where(F.size("vec") == length).select("vec").sample(fraction=min(1.0, rows / n), seed=3).limit(rows).toArrow()
        found[length] = fit_centres(unit_rows(np.array(sample.column(0).to_pylist())), k)
    return found


def _products(nodes: DataFrame, centres: dict[int, np.ndarray], threshold: float) -> DataFrame:
    """Rows (a, b, n): with b null, ``n`` vectors link with node a; else an edge a-b."""
    kind, label = nodes.schema["vec"].dataType.simpleString(), nodes.schema["label"].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        within = {length: margins(found, threshold) for length, found in centres.items()}
        for batch in batches:
            lengths = np.diff(batch.column(3).offsets.to_numpy())
            for length in np.unique(lengths).tolist():
                part = batch.take(pa.array(np.nonzero(lengths == length)[0]))
                unit = unit_rows(part.column(3).flatten().to_numpy().reshape(-1, length))
                home, visits = cells_of(unit, centres[length], within[length])
                row, cell = np.nonzero(visits)
                every = np.concatenate([np.arange(len(home)), row])
                taken = part.take(pa.array(every))
                visited = pa.array([np.nonzero(v)[0].astype(np.int32) for v in visits], pa.list_(pa.int32())).take(pa.array(every))
                yield pa.RecordBatch.from_arrays(
                    [*taken.columns, pa.array(np.full(len(every), length, np.int32)), pa.array(np.concatenate([home, cell]).astype(np.int32)), pa.array(home[every].astype(np.int32)), visited], names=["node", "label", "copies", "vec", "length", "cell", "home", "visits"]
                )

    placed = nodes.select("node", "label", "copies", "vec").mapInArrow(assign, f"node long, label {label}, copies long, vec {kind}, length int, cell int, home int, visits array<int>")
    placed = materialize(placed, "vector-cells")
    key = ["label", "length", "cell"]
    lives = F.col("cell") == F.col("home")
    blocks = lambda n: F.ceil(n / BLOCK_ROWS).cast("int")
    sizes = placed.groupBy(key).agg(blocks(F.count_if(lives)).alias("homes"), blocks(F.count_if(~lives)).alias("guests"), F.count("*").alias("all")).where("homes > 0 and all > 1").drop("all")
    # Blocks of inhabitants first: they meet all blocks, those of visitors only them.
    block = F.when(lives, F.pmod(F.xxhash64("node"), F.col("homes"))).otherwise(F.col("homes") + F.pmod(F.xxhash64("node"), F.col("guests"))).cast("int")
    meets = F.when(lives, F.col("homes") + F.col("guests")).otherwise(F.col("homes"))
    units = placed.join(sizes, key).withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), meets - 1)))
    units = units.select(*key, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "copies", "home", "visits", "vec")

    def multiply(key_values: tuple, table: pa.Table) -> pa.Table:
        cell, i, j = (key_values[k].as_py() for k in (2, 3, 4))
        column = {n: table.column(n).to_numpy() for n in ("block", "node", "copies", "home")}
        vec = table.column("vec").combine_chunks()
        unit = unit_rows(vec.flatten().to_numpy().reshape(table.num_rows, -1))
        visits = np.zeros((table.num_rows, len(centres[unit.shape[1]])), bool)
        for row, cells in enumerate(table.column("visits").to_pylist()):
            visits[row, cells] = True
        a, b = np.nonzero(column["block"] == i)[0], np.nonzero(column["block"] == j)[0]
        near = unit[a] @ unit[b].T >= threshold
        if i == j:
            near = np.triu(near, 1)
        rows, cols = column["home"][a], column["home"][b]
        here_a, here_b = rows == cell, cols == cell
        near &= here_a[:, None] | here_b[None]  # two guests meet elsewhere
        # One lives here and one visits: where both cells see the pair, the lower one counts it.
        near &= ~(here_a[:, None] & ~here_b[None] & visits[a][:, cols] & (cols < cell)[None])
        near &= ~(~here_a[:, None] & here_b[None] & visits[b][:, rows].T & (rows < cell)[:, None])
        node, copies = column["node"], column["copies"]
        of_a, of_b = near @ copies[b], near.T @ copies[a]
        edges = _forest(near) if near.any() else []
        first = np.concatenate([node[a][of_a > 0], node[b][of_b > 0], np.array([node[a[r]] for r, _ in edges], np.int64)])
        n = np.concatenate([of_a[of_a > 0], of_b[of_b > 0], np.zeros(len(edges), np.int64)])
        second = pa.array([None] * (len(first) - len(edges)) + [int(node[b[c]]) for _, c in edges], pa.int64())
        return pa.table({"a": pa.array(first, pa.int64()), "b": second, "n": pa.array(n, pa.int64())})

    return units.groupBy(*key, "i", "j").applyInArrow(multiply, "a long, b long, n long")


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all ``embeddings``; see ``vector_links``."""
    return vector_links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP3_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, least(a, min(b)) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, coalesce(c.component_id, vec_id) AS component_id, coalesce(c.component_id, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""
