"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint of 64 bits is cut into two segments, so that two fingerprints within three bits differ by
at most one bit in one of them.  Each segment is indexed under its exact value and, for every bit, under
its value with that bit left out (one wildcard).  Two segments that differ by at most one bit share
exactly one such key at which they must be compared: the exact one, or the wildcard at the bit that
differs.  Signatures are shuffled by key once; equal keys stand together in a sorted partition and the
whole distance is verified.

Equal fingerprints are one node, so exact copies never meet.  A key that many different fingerprints
share is cut by parts of the other segment, of which one must be equal, then into blocks of bounded size
whose pairs are units of work.  A unit returns the edges of a spanning forest of its links, never all
its pairs.

``near_copies`` asks for a similarity of texts instead of bits.  Fingerprints find most of its links;
what they can miss is found through shared shingles, so that it is complete.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quern.llm.graph import components
from quern.llm.storage import discard, materialize, small_batches
from quern.llm.words import encoded_words

#: Fingerprints of one key that are compared as one block.
BLOCK_ROWS = 512
#: Signatures that a task makes or reads, about.
SIGNATURES_PER_TASK = 1_000_000
#: Shingles whose bits are counted at once.
CHUNK = 16384
#: Bits of a segment; keys of one: a wildcard at each bit, and the exact one.
WIDTH = 32
KEYS = WIDTH + 1
#: Parts of the other segment that frequent keys are cut by: more than the bits that may differ.
PARTS = 4


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of ``size`` lower-cased words, repeats included; fewer words
    make one shingle, no words none."""
    from xxhash import xxh64_intdigest

    words = encoded_words(text, lower=True)
    if not words:
        return np.empty(0, np.uint64)
    last = max(1, len(words) - size + 1)
    return np.fromiter((xxh64_intdigest(b" ".join(words[k : k + size]), 42) for k in range(last)), np.uint64, last)


def bit_majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half of the hashes, as a signed long; 0 for none."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = np.ascontiguousarray(hashes[at : at + CHUNK]).astype("<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """Rows (id, fp long): the fingerprint of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [bit_majority(shingle_hashes(text.as_py(), shingle)) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["id", "fp"])

    small_batches(docs.sparkSession)
    key = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {key}, fp long")


def _signature() -> Column:
    """Key of column ``fp`` under column ``code``, which is KEYS times the segment plus the place of the
    wildcard (WIDTH: none)."""
    fp, code = F.col("fp"), F.col("code")
    wild = code % KEYS
    value = F.when(code < KEYS, fp.bitwiseAND(F.lit((1 << WIDTH) - 1))).otherwise(F.shiftrightunsigned(fp, WIDTH))
    rest = F.when(wild == WIDTH, value).otherwise(value.bitwiseAND(F.bitwise_not(F.expr(f"shiftleft(1L, code % {KEYS})"))))
    return F.shiftleft(code.cast("long"), WIDTH).bitwiseOR(rest)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of all of a (rows) and b (columns)."""
    return np.bitwise_count(a[:, None] ^ b[None, :])


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges (row, column) that connect what the Boolean matrix connects."""
    left_rows, edges = set(np.nonzero(linked.any(axis=1))[0].tolist()), []
    seen_cols = np.zeros(linked.shape[1], bool)
    while left_rows:
        stack = [left_rows.pop()]
        while stack:
            r = stack.pop()
            fresh = np.nonzero(linked[r] & ~seen_cols)[0]
            seen_cols[fresh] = True
            for c in fresh.tolist():
                edges.append((r, c))
                for other in np.nonzero(linked[:, c])[0].tolist():
                    if other in left_rows:
                        left_rows.discard(other)
                        edges.append((other, c))
                        stack.append(other)
    return edges


def links(prints: DataFrame, max_bits: int = 3, block_rows: int = BLOCK_ROWS, few_files: bool = False) -> DataFrame:
    """Edges (a, b) between fingerprints (fp long, all different) of at most ``max_bits`` (up to 3)
    differing bits.  They connect what all links connect, but are few: at most two per fingerprint and
    unit of work.  ``few_files``: as many files of them as rows are sure to take, not one per task."""
    prints = materialize(prints.select("fp"), "simhash-prints")
    # The table is small, what is made of it is not: tasks by the rows that they will make.
    tasks = max(1, prints.count() * 2 * KEYS // SIGNATURES_PER_TASK)
    coded = prints.repartition(tasks, "fp").select("fp", F.explode(F.sequence(F.lit(0), F.lit(2 * KEYS - 1))).alias("code"))
    # The key follows from the fingerprint and the code: it is made again behind the shuffle.
    key = _signature()
    keyed = coded.repartition(tasks, key).select(key.alias("key"), "fp").sortWithinPartitions("key")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, fps, whole in _runs(batches, block_rows):
            if whole:
                code = key >> WIDTH
                wild = code % KEYS
                if wild == WIDTH:
                    near = np.triu(_distances(fps, fps) <= max_bits, 1)
                    one = two = fps
                else:  # at a wildcard, only those meet that differ in the hidden bit
                    hidden = fps >> np.uint64(WIDTH * (code // KEYS) + wild) & np.uint64(1) == 1
                    one, two = fps[hidden], fps[~hidden]
                    near = _distances(one, two) <= max_bits
                if near.any():
                    yield _edges(one, two, near)
            else:
                n = len(fps)
                yield pa.RecordBatch.from_arrays([pa.array(fps.view(np.int64)), pa.nulls(n, pa.int64()), pa.array(np.full(n, key, np.int64))], names=["a", "b", "key"])

    # Rows are no more than signatures, whose tasks are so many files.
    found = materialize(keyed.mapInArrow(compare, "a long, b long, key long"), "simhash-links", tasks * SIGNATURES_PER_TASK if few_files else None)
    frequent = found.where("key is not null").select("key", F.col("a").alias("fp"))
    edges = found.where("key is null").select("a", "b")
    if not frequent.isEmpty():
        edges = edges.union(_frequent_links(frequent, max_bits, block_rows))
    return edges.distinct()


def _edges(one: np.ndarray, two: np.ndarray, near: np.ndarray) -> pa.RecordBatch:
    pairs = np.array(_forest(near))
    a, b = one[pairs[:, 0]].view(np.int64), two[pairs[:, 1]].view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.nulls(len(a), pa.int64())], names=["a", "b", "key"])


def _runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, np.ndarray, bool]]:
    """(key, fingerprints, whole) of the keys of a sorted partition that have something to compare: up to
    ``most`` fingerprints at once, more as pieces that are not the whole key."""
    held: list[np.ndarray] = []
    mark, rows, cut = None, 0, False

    def ended() -> Iterator[tuple[int, np.ndarray, bool]]:
        if rows > 1 or cut and rows:
            yield mark, np.concatenate(held), not cut

    for batch in batches:
        key, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
        if not len(key):
            continue
        starts = np.nonzero(np.concatenate([[True], key[1:] != key[:-1]]))[0]
        sizes = np.diff(starts, append=len(key))
        code = key[starts] >> WIDTH
        shift = np.where(code % KEYS == WIDTH, 0, WIDTH * (code // KEYS) + code % KEYS).astype(np.uint64)
        ones = np.add.reduceat((fp >> np.repeat(shift, sizes) & np.uint64(1)).astype(np.int64), starts)
        # A wildcard key at which all agree in the hidden bit has nothing that the exact key has not.
        useful = (sizes > 1) & ((code % KEYS == WIDTH) | (ones > 0) & (ones < sizes))
        useful[[0, -1]] = True  # these may go on in another batch
        for k in np.nonzero(useful)[0].tolist():
            now, part = int(key[starts[k]]), fp[starts[k] : starts[k] + sizes[k]]
            if now != mark:
                yield from ended()
                held, mark, rows, cut = [], now, 0, False
            held.append(part.copy())
            rows += len(part)
            if rows > most:
                yield now, np.concatenate(held), False
                held, rows, cut = [], 0, True
    yield from ended()


def _frequent_links(members: DataFrame, max_bits: int, block_rows: int) -> DataFrame:
    """Edges (a, b) within the keys of rows (key, fp).

    Two of a key may link only if one of the parts of the other segment is equal as well, so a key
    falls apart by these; what is still above ``block_rows`` is compared block by block."""
    step = WIDTH // PARTS
    other = F.when(F.shiftrightunsigned("key", WIDTH) < KEYS, F.shiftrightunsigned("fp", WIDTH)).otherwise(F.col("fp").bitwiseAND(F.lit((1 << WIDTH) - 1)))
    parts = F.array(*[F.shiftrightunsigned(other, k * step).bitwiseAND(F.lit((1 << step) - 1)) + (k << step) for k in range(PARTS)])
    cut = members.select("key", "fp", F.explode(parts).alias("part"))
    sizes = cut.groupBy("key", "part").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"), F.count("*").alias("n")).where("n > 1").drop("n")
    placed = cut.join(sizes, ["key", "part"]).withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    # Unit (i, j), i <= j: block i against block j. A row goes to the units of its block.
    units = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", "part", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "fp", "block")

    def compare(unit: pa.Table) -> pa.Table:
        fp, block, i, j = (unit.column(c).to_numpy() for c in ("fp", "block", "i", "j"))
        one, two = fp.view(np.uint64)[block == i], fp.view(np.uint64)[block == j]
        near = _distances(one, two) <= max_bits
        if i[0] == j[0]:
            near = np.triu(near, 1)
        edges = [_edges(one, two, near)] if near.any() else []
        return pa.Table.from_batches(edges, EDGES).select(["a", "b"])

    return units.groupBy("key", "part", "i", "j").applyInArrow(compare, "a long, b long")


EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64())])


def hex_fingerprint(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """Fingerprint and component of every document.

    Rows (id, fingerprint string, component_id): documents link when their 64-bit fingerprints differ
    by ``max_bits`` (at most 3) or fewer bits, and component_id is the least id that links reach.
    Complete and exact.  Null and empty texts have fingerprint 0, which links like any other; repeated
    rows come back repeated; a null id is never a component_id unless a component has no other.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("two segments of 32 bits are complete for at most 3 bits")
    marked = materialize(fingerprints(docs, id_col, text_col, shingle), "simhash-fp")
    # One node per fingerprint. From here rows are narrow, and every task would leave a small file in each
    # of the tables: their files follow the number of nodes.
    nodes = materialize(marked.groupBy("fp").agg(F.min("id").alias("least_id")), "simhash-groups", marked.count())
    n = nodes.count()
    found = components(links(nodes, max_bits, few_files=True), "a", "b", rows=n).withColumnRenamed("node", "fp")
    of_node = nodes.join(found, "fp", "left").select("fp", "least_id", F.coalesce("component", "fp").alias("component"))
    least = of_node.groupBy("component").agg(F.min("least_id").alias("component_id"))
    table = materialize(of_node.join(least, "component").select("fp", "component_id"), "simhash-components", n)
    out = marked.join(table, "fp").select("id", hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")
    return out.withColumnsRenamed({"id": id_col})


#: Share of the texts whose shingles are counted to tell frequent ones, and how many of these are kept.
SAMPLED_SHARE, FREQUENT_SHINGLES = 0.02, 1 << 17
#: Nodes of a key up to which its pairs are listed; more are compared in blocks of so many rows.
PAIRS_UPTO, SET_BLOCK_ROWS = 32, 256
#: Shingles of prefixes that one task sorts, about.
PREFIXES_PER_TASK = 1_000_000


def shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(node, shingles array<int>) of rows (node, text): 32 bits of every different shingle's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [np.unique(shingle_hashes(text.as_py(), shingle).astype(np.uint32)).view(np.int32) for text in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int32()))], names=["node", "shingles"])

    return docs.select("node", "text").mapInArrow(run, "node long, shingles array<int>")


def prefix_size(n: int, similarity: float) -> int:
    """Two sets at or above ``similarity`` share one of so many least elements of each, in any common order."""
    return n - int(np.ceil(similarity * n - 1e-9)) + 1 if n else 0


def _prefixes(texts: DataFrame, shingle: int, similarity: float, frequent: np.ndarray) -> DataFrame:
    """(id, tie, node, n, fp, prefix array<long>) of rows (id, tie, text): a hash of the set of shingles,
    its size, its fingerprint and its least elements, where ``frequent`` shingles (the most frequent
    first) come last."""
    values = np.sort(frequent)
    ranks = (len(frequent) - np.argsort(frequent)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                nodes, sizes, prints, prefixes = [], [], [], []
                for text in batch.column(2):
                    found = np.unique(shingle_hashes(text.as_py(), shingle))
                    rank = np.zeros(len(found), np.int64)
                    if len(values):
                        low = found.astype(np.uint32).view(np.int32)
                        place = np.minimum(np.searchsorted(values, low), len(values) - 1)
                        rank = np.where(values[place] == low, ranks[place], 0)
                    order = np.lexsort((found * np.uint64(0x9E3779B97F4A7C15), rank))
                    nodes.append(xxh3_64_intdigest(found.tobytes()) - (1 << 63))
                    sizes.append(len(found))
                    prints.append(bit_majority(found))
                    prefixes.append(found[order[: prefix_size(len(found), similarity)]].view(np.int64))
                made = [pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(prints, pa.int64()), pa.array(prefixes, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["id", "tie", "node", "n", "fp", "prefix"])

    return texts.select("id", "tie", "text").mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, tie long, node long, n int, fp long, prefix array<long>")


def _frequent_shingles(texts: DataFrame, shingle: int) -> np.ndarray:
    """The most frequent shingles of a fixed share of the different texts, the most frequent first.  They
    decide what is compared in vain, never what is found."""
    sample = texts.where(F.pmod("tie", F.lit(1 << 20)) < int(SAMPLED_SHARE * (1 << 20))).select(F.col("tie").alias("node"), "text").dropDuplicates(["node"])
    counts = shingle_sets(sample, shingle).select(F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("n")).where("n > 2")
    return np.array([r["s"] for r in counts.orderBy(F.desc("n"), "s").limit(FREQUENT_SHINGLES).select("s").collect()], np.int32)


def _shared_prefixes(marked: DataFrame) -> DataFrame:
    """(key, node, pos) of the shingles that the prefixes of two nodes or more have in common; ``pos`` is
    the place in the prefix.  One shuffle; a key of any size streams through its task."""
    total = marked.agg(F.sum(F.size("prefix"))).first()[0] or 0
    rows = marked.select("node", F.posexplode("prefix").alias("pos", "key"))
    dealt = rows.repartition(max(1, total // PREFIXES_PER_TASK), "key").sortWithinPartitions("key", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sent = None, False  # the last row so far, and whether it went out
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k).to_numpy() for k in range(3)]
            node, pos, key = columns if last is None else (np.concatenate(x) for x in zip(last, columns, strict=True))
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])])  # repeated rows go
            node, pos, key = node[new], pos[new], key[new]
            same = key[1:] == key[:-1]
            out = np.concatenate([same, [False]]) | np.concatenate([[False], same])
            ended = bool(out[-1]) if len(key) > 1 else sent
            out[0] &= not sent
            last, sent = (node[-1:].copy(), pos[-1:].copy(), key[-1:].copy()), ended
            if out.any():
                yield pa.RecordBatch.from_arrays([pa.array(node[out]), pa.array(pos[out]), pa.array(key[out])], names=["node", "pos", "key"])

    return dealt.mapInArrow(run, "node long, pos int, key long")


def _similar_sets(a: list[np.ndarray], b: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which sets of a (rows) and b (columns) have a Jaccard similarity of at least ``similarity``."""
    sizes = np.array([len(x) for x in b])
    values, owner = np.concatenate(b), np.repeat(np.arange(len(b)), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    out = np.zeros((len(a), len(b)), bool)
    for r, x in enumerate(a):
        first, last = np.searchsorted(values, x, "left"), np.searchsorted(values, x, "right")
        length = last - first
        at = np.repeat(first - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
        common = np.bincount(owner[at], minlength=len(b))
        out[r] = common >= similarity * (len(x) + sizes - common)
    return out


def _possible(x: str, y: str, similarity: float) -> Column:
    """Whether the nodes of two rows of a key can reach the similarity.

    Rows have n (size of the set), pos (place of the key in the prefix) and rank (how many keys of the
    node's prefix are shared with anyone, up to this one).  Up to the key, both have at most the smaller
    rank in common, since common elements so early are in both prefixes; behind it, at most what is left."""
    n_x, n_y = F.col(f"n_{x}"), F.col(f"n_{y}")
    most = F.least(f"rank_{x}", f"rank_{y}") + F.least(n_x - F.col(f"pos_{x}"), n_y - F.col(f"pos_{y}")) - 1
    return (F.least(n_x, n_y) >= similarity * F.greatest(n_x, n_y)) & (most * (1 + similarity) >= similarity * (n_x + n_y) - 1e-6)


def _block_links(members: DataFrame, similarity: float) -> DataFrame:
    """Edges (a, b) that connect what all links between the components of each key connect.

    Rows (key, m, node, component, n, pos, rank, shingles), ``m`` rows of a key.  Every two blocks of a
    key are one unit; in it every possible pair of different components is verified and a spanning
    forest of the links returned."""
    blocks = F.ceil(F.col("m") / SET_BLOCK_ROWS).cast("int")
    cut = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    units = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "component", "n", "pos", "rank", "shingles")

    def compare(unit: pa.Table) -> pa.Table:
        block, i, j, node, component, n, pos, rank = (unit.column(c).to_numpy() for c in ("block", "i", "j", "node", "component", "n", "pos", "rank"))
        first, second = np.nonzero(block == i)[0], np.nonzero(block == j)[0]
        above, edges = {}, []

        def root(x: int) -> int:
            while x in above:
                x = above[x]
            return x

        n_x, n_y = n[first][:, None], n[second][None]
        most = np.minimum(rank[first][:, None], rank[second][None]) + np.minimum((n - pos)[first][:, None], (n - pos)[second][None]) - 1
        open_pairs = (component[first][:, None] != component[second][None]) & (np.minimum(n_x, n_y) >= similarity * np.maximum(n_x, n_y)) & (most * (1 + similarity) >= similarity * (n_x + n_y) - 1e-6)
        first, open_pairs = first[open_pairs.any(axis=1)], open_pairs[open_pairs.any(axis=1)]
        second, open_pairs = second[open_pairs.any(axis=0)], open_pairs[:, open_pairs.any(axis=0)]
        if open_pairs.size:
            sets = [x.values.to_numpy(zero_copy_only=False) for x in unit.column("shingles")]
            linked = _similar_sets([sets[k] for k in first], [sets[k] for k in second], similarity) & open_pairs
            for r, c in zip(*np.nonzero(linked), strict=True):
                one, two = root(int(component[first[r]])), root(int(component[second[c]]))
                if one != two:
                    above[one] = two
                    edges.append((int(node[first[r]]), int(node[second[c]])))
        return pa.table({"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())})

    return units.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long")


def _print_pairs(nodes: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) that fingerprints propose: every node and the first one of its fingerprint, and the
    first ones of fingerprints that link by deletion variants."""
    prints = materialize(nodes.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("first")).select("fp", F.col("first.node").alias("node"), F.col("first.n").alias("n")), "copies-prints")
    equal = nodes.select("fp", F.col("node").alias("x"), F.col("n").alias("n_x")).join(prints.select("fp", F.col("node").alias("y"), F.col("n").alias("n_y")), "fp").where("x <> y").select("x", "n_x", "y", "n_y")
    near = links(prints)
    for end, other in (("a", "x"), ("b", "y")):
        near = near.join(prints.select(F.col("fp").alias(end), F.col("node").alias(other), F.col("n").alias(f"n_{other}")), end)
    both = equal.union(near.select("x", "n_x", "y", "n_y")).where(F.least("n_x", "n_y") >= similarity * F.greatest("n_x", "n_y"))
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """Groups of near copies by word shingles: rows (id, tie, group), ``tie`` a hash of the text.

    Two texts link when their sets of word shingles (32 bits of each) have a Jaccard similarity of at
    least ``similarity``; a group is what links connect.  Complete.  Candidates come from SimHash
    fingerprints by deletion variants, and from shingles for the links that fingerprints miss: similar sets
    share one of their few first shingles in any common order, here the rare ones first.  Of the nodes
    with a common first shingle, each is verified with the one whose shingles are shared most; then every
    possible pair that all this left in different components is verified as well.  Equal sets are one
    node, and so are all texts without words.  ``group`` is a number; repeated rows share it.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).withColumn("tie", F.xxhash64("text"))
    marked = materialize(_prefixes(texts, shingle, similarity, _frequent_shingles(texts, shingle)), "copies-prefixes")
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "tie")).alias("first")
    nodes = materialize(marked.groupBy("node").agg(F.first("n").alias("n"), F.first("fp").alias("fp"), first), "copies-nodes")
    by_print = materialize(_print_pairs(nodes, similarity).distinct(), "copies-prints")

    shared = materialize(_shared_prefixes(marked), "copies-shared")
    rows = materialize(marked.select("id", "tie", "node"), "copies-rows")
    discard(marked)
    counts = shared.groupBy("key").agg(F.count("*").cast("int").alias("m"))
    in_order = Window.partitionBy("node").orderBy("pos")  # of a node: no more rows than its prefix
    of_node = Window.partitionBy("node")
    members = shared.join(nodes.select("node", "n"), "node").withColumn("rank", F.row_number().over(in_order)).withColumn("score", F.count("*").over(of_node) / F.col("n"))
    members = materialize(members.join(counts, "key"), "copies-members-of-keys")
    discard(shared)
    row = [F.col(c) for c in ("node", "n", "pos", "rank")]
    centres = members.groupBy("key").agg(F.max(F.struct("score", *row)).alias("c")).select("key", *[F.col(f"c.{c}").alias(f"{c}_y") for c in ("node", "n", "pos", "rank")])
    stars = members.select("key", *[F.col(c).alias(f"{c}_x") for c in ("node", "n", "pos", "rank")]).join(centres, "key").where("node_x <> node_y").where(_possible("x", "y", similarity))
    stars = materialize(stars.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct(), "copies-stars")
    # A key of two has no pair but that with its centre.
    x, y = (members.where(F.col("m").between(3, PAIRS_UPTO)).select("key", *[F.col(c).alias(f"{c}_{k}") for c in ("node", "n", "pos", "rank")]) for k in "xy")
    few = x.join(y, "key").where("node_x < node_y").where(_possible("x", "y", similarity)).select(F.col("node_x").alias("a"), F.col("node_y").alias("b")).distinct()
    few = materialize(few.join(stars, ["a", "b"], "left_anti"), "copies-few")

    compared = members.where(F.col("m") > PAIRS_UPTO).select("node")
    for pairs in (by_print, stars, few):
        compared = compared.union(pairs.select("a")).union(pairs.select("b"))
    wanted = nodes.join(compared.distinct(), "node", "left_semi").select("node", F.col("first.id").alias("of_id"), F.col("first.tie").alias("of_tie"))
    chosen = texts.join(wanted, texts["id"].eqNullSafe(F.col("of_id")) & (texts["tie"] == F.col("of_tie"))).select("node", "text").dropDuplicates(["node"])
    sets = materialize(shingle_sets(chosen, shingle), "copies-shingles")

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b")), "b")
        common = F.size(F.array_intersect("of_a", "of_b"))
        return both.where(common >= similarity * (F.size("of_a") + F.size("of_b") - common)).select("a", "b")

    edges = materialize(verified(by_print.union(stars).distinct()), "copies-verified")
    found = materialize(components(edges, "a", "b"), "copies-components")
    ends = few
    for end in "ab":
        ends = ends.join(found.select(F.col("node").alias(end), F.col("component").alias(f"component_{end}")), end, "left").withColumn(f"component_{end}", F.coalesce(f"component_{end}", end))
    rest = materialize(verified(ends.where("component_a <> component_b").select("a", "b")), "copies-rest")
    many = members.where(F.col("m") > PAIRS_UPTO).join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_keys = many.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most").select("key")
    many = many.join(open_keys, "key").select("key", "m", "node", "component", "n", "pos", "rank").join(sets, "node")
    blocks = materialize(_block_links(many, similarity), "copies-blocks")
    table = materialize(components(edges.union(rest).union(blocks), "a", "b"), "copies-groups")
    discard(nodes, by_print, members, stars, few, sets, edges, found, rest, blocks)
    return rows.join(table, "node", "left").select("id", "tie", F.coalesce("component", "node").alias("group"))


def keep_one_copy(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs``, all columns, without near copies: of each group of ``near_copies`` the
    document with the least id stays (nulls last, then the least hash of the text)."""
    groups = near_copies(docs, id_col, text_col, shingle, similarity)
    groups = materialize(groups, "copies-members")
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "tie")
    kept = groups.groupBy("group").agg(F.min(order).alias("x")).select("x.id", "x.tie")
    # Few rows as a rule: keys that go, and keys of repeated rows of which one stays.
    keys = groups.groupBy("id", "tie").agg(F.count("*").alias("n"))
    gone = materialize(keys.join(kept, keys["id"].eqNullSafe(kept["id"]) & (keys["tie"] == kept["tie"]), "left_anti"), "copies-gone")
    twice = keys.where("n > 1").select("id", "tie")
    # The columns of docs travel as one, so that their names meet no other.
    tied = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].alias("key"), F.xxhash64(docs[text_col]).alias("key_tie"))
    key, tie = F.col("key"), F.col("key_tie")
    left = tied.join(gone, key.eqNullSafe(gone["id"]) & (tie == gone["tie"]), "left_anti")
    again = materialize(twice, "copies-twice")
    match = key.eqNullSafe(again["id"]) & (tie == again["tie"])
    if not again.isEmpty():
        left = left.join(again, match, "left_anti").union(left.join(again, match, "left_semi").dropDuplicates(["key", "key_tie"]))
    return left.select("row.*")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all ``documents``; see ``near_duplicates``."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
