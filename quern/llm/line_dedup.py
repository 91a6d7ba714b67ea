"""Line dedup by pairwise alignment.

Short lines are common, so what brings two documents together is a *rare line*: a line of enough words,
or the shortest run of adjacent lines that has them.  Its hash is looked up in all documents, and every
holder is paired with the first one, at any number of holders.  A pair is aligned by patience diff: of the
lines that lie in shared rare lines, those that occur once in both documents, in longest increasing order,
are the anchors, and repeated ones are aligned between them.  Aligned lines without a gap are common
blocks; those that hold a rare line are deleted from the later document.  A shared rare line that no
alignment of its pair takes in, because it stands in another order, is deleted as a block of its own,
so that no repeated passage is passed over.  Documents are ordered by id, so the first holder of a line
always keeps it.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from quern.llm.storage import materialize, small_batches, unused
from quern.llm.words import WHITE_SPACE

#: Words of the smallest common block that is deleted.
LEAST_BLOCK_WORDS = 20


def worded_lines(text: str | None) -> list[tuple[int, bytes, int]]:
    """(index among all lines, stripped line, words) of the lines that hold a word."""
    out = []
    for at, line in enumerate((text or "").split("\n")):
        words = line.encode("utf-8", "surrogatepass").split()
        if words:
            out.append((at, line.strip(WHITE_SPACE).encode("utf-8", "surrogatepass"), len(words)))
    return out


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest subsequence of ``pairs`` (sorted by the first) that rises in the second."""
    tails, at_tail, before = [], [], []
    for k, (_, second) in enumerate(pairs):
        place = bisect_left(tails, second)
        before.append(at_tail[place - 1] if place else -1)
        if place == len(tails):
            tails.append(second), at_tail.append(k)
        else:
            tails[place], at_tail[place] = second, k
    out, k = [], at_tail[-1] if at_tail else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def align(shared: list[tuple[int, int, bool]]) -> list[tuple[int, int]]:
    """Patience diff of the shared lines (place in the later, place in the earlier, unique in both),
    sorted by the first place.  Returns aligned places, rising in both."""
    anchors = increasing([(d, p) for d, p, unique in shared if unique])
    repeated = [(d, p) for d, p, unique in shared if not unique]
    if not repeated:
        return anchors
    later, gaps = [d for d, _ in anchors], {}
    for d, p in repeated:
        gap = bisect_right(later, d)
        if (gap == 0 or anchors[gap - 1][1] < p) and (gap == len(anchors) or p < anchors[gap][1]) and (gap == 0 or anchors[gap - 1][0] < d):
            gaps.setdefault(gap, []).append((d, p))
    return sorted(anchors + [x for inner in gaps.values() for x in increasing(inner)])


def common_blocks(runs: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Ranges (first, last place in the later document) of the common blocks of a pair of documents.

    ``runs`` are the shared rare lines: first and last place in the later, first place in the earlier."""
    if len(runs) == 1:
        return [runs[0][:2]]
    lines = sorted({(first + k, at + k) for first, last, at in runs for k in range(last - first + 1)})
    later, earlier = Counter(d for d, _ in lines), Counter(p for _, p in lines)
    blocks, run = [], []
    for d, p in [*align([(d, p, later[d] == 1 and earlier[p] == 1) for d, p in lines]), (-9, -9)]:
        if run and (d, p) != (run[-1][0] + 1, run[-1][1] + 1):
            blocks.append((run[0][0], run[-1][0], run[0][1] - run[0][0]))
            run = []
        run.append((d, p))
    starts, found, moved = [b[0] for b in blocks], set(), []
    for first, last, at in runs:
        k = bisect_right(starts, first) - 1
        if k >= 0 and last <= blocks[k][1] and at - first == blocks[k][2]:
            found.add(blocks[k][:2])
        else:
            moved.append((first, last))
    return sorted(found) + moved


def least_runs(words: list[int], least_words: int = LEAST_BLOCK_WORDS) -> list[tuple[int, int]]:
    """Ranges (first, last) of the rare lines: the shortest runs with enough words from every line on and
    up to every line.

    Those inside of any longer run with enough words cover all of it."""
    out, last, total = set(), -1, 0
    for first in range(len(words)):
        while total < least_words and last + 1 < len(words):
            last += 1
            total += words[last]
        if total < least_words:
            break
        out.add((first, last))
        total -= words[first]
    first, total = 0, 0
    for last, n in enumerate(words):
        total += n
        while total - words[first] >= least_words:
            total -= words[first]
            first += 1
        if total >= least_words:
            out.add((first, last))
    return sorted(out)


def run_table(docs: DataFrame, least_words: int = LEAST_BLOCK_WORDS) -> DataFrame:
    """``least_runs`` of rows (id, tie, text): + h1, h2 (128-bit hash of the lines), first, last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                batch = whole.slice(at, 128)
                row, places, hashes = [], [], []
                for k, text in enumerate(batch.column(2)):
                    lines = worded_lines(text.as_py())
                    for first, last in least_runs([n for _, _, n in lines], least_words):
                        hashes.append(xxh3_128_digest(lines[first][1] if first == last else b"\n".join(line for _, line, _ in lines[first : last + 1])))
                        row.append(k)
                        places += (first, last)
                if row:
                    h = np.frombuffer(b"".join(hashes), ">i8").astype(np.int64).reshape(-1, 2)
                    place = np.array(places, np.int32).reshape(-1, 2)
                    taken = batch.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([taken.column(0), taken.column(1), *(pa.array(np.ascontiguousarray(c)) for c in (h[:, 0], h[:, 1], place[:, 0], place[:, 1]))], names=["id", "tie", "h1", "h2", "first", "last"])

    return docs.mapInArrow(run, f"id {key_type(docs)}, tie long, h1 long, h2 long, first int, last int")


def deleted_ranges(docs: DataFrame, least_words: int = LEAST_BLOCK_WORDS) -> DataFrame:
    """Rows (id, tie, ranges array<struct<first, last>>) for rows (id, tie, text): the common blocks of
    each document with earlier ones, in places among its lines with words.

    A task gets the shared rare lines of a later document, which are no more than its own lines; what an
    earlier one has is known by place, so its other holders never meet."""
    held = materialize(run_table(docs, least_words), "line-runs").withColumn("holder", F.struct(F.col("id").isNull().alias("no_id"), "id", "tie"))
    shared = held.groupBy("h1", "h2").agg(F.min(F.struct("holder", "first")).alias("earliest"), F.max("holder").alias("latest")).where("earliest.holder < latest").select("h1", "h2", "earliest")
    later = held.join(shared, ["h1", "h2"]).where("earliest.holder < holder").select("id", "tie", F.col("earliest.holder.id").alias("eid"), F.col("earliest.holder.tie").alias("etie"), "first", "last", F.col("earliest.first").alias("at"))
    dealt = later.repartition("id", "tie").sortWithinPartitions("id", "tie")
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark, pairs, out = None, defaultdict(set), []

        def ended() -> None:
            if mark is not None:
                blocks = {b for runs in pairs.values() for b in common_blocks(sorted(runs))}
                out.append((*mark, [{"first": a, "last": b} for a, b in sorted(blocks)]))

        def emitted(key: pa.DataType) -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (key, pa.int64(), kind), strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names=["id", "tie", "ranges"])

        key = None
        for batch in batches:
            key = batch.column(0).type
            for doc, tie, *earlier, first, last, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (doc, tie) != mark:
                    ended()
                    mark, pairs = (doc, tie), defaultdict(set)
                pairs[tuple(earlier)].add((first, last, at))  # a set: a repeated document brings its rows twice
            if out:
                yield emitted(key)
        ended()
        if out:
            yield emitted(key)

    return dealt.mapInArrow(run, f"id {key_type(docs)}, tie long, ranges array<struct<first: int, last: int>>")


def key_type(docs: DataFrame) -> str:
    return docs.schema["id"].dataType.simpleString()


def without_ranges(text: str | None, ranges: list[dict] | None) -> tuple[str | None, int, int]:
    """(text, lines with words, deleted ones): ``text`` without the lines of the ranges."""
    lines = worded_lines(text)
    if not ranges:
        return text, len(lines), 0
    gone = {place for r in ranges for place in range(r["first"], r["last"] + 1)}
    numbers = {at for place, (at, _, _) in enumerate(lines) if place in gone}
    return "\n".join(line for at, line in enumerate(text.split("\n")) if at not in numbers), len(lines), len(gone)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_BLOCK_WORDS) -> DataFrame:
    """All rows and columns of ``docs`` with common blocks deleted from ``text``, + __lines, __deleted
    (with more underscores behind where ``docs`` has these names).

    Lines are compared without white space at their ends; blank lines never part a block.  Null and
    empty texts have no lines and stay as they are.  Documents are ordered by id, nulls last, then by a
    hash of the text; repeated rows are one document and lose the same lines.  The longest document
    is one row of work.
    """
    small_batches(docs.sparkSession)
    # The columns of docs travel as one, so that their names meet no other.
    marked = docs.select(docs[id_col].alias("key"), F.xxhash64(docs[text_col]).alias("tie"), docs[text_col].alias("text"), F.struct(*[docs[c] for c in docs.columns if c != text_col]).alias("row"))
    ranges = materialize(deleted_ranges(marked.select(F.col("key").alias("id"), "tie", "text"), least_words), "line-ranges")
    # Always by a shuffle: a broadcast of the ranges would grow with the corpus.
    ranges = ranges.select("id", F.col("tie").alias("of_tie"), "ranges").hint("merge")
    joined = marked.join(ranges, marked["key"].eqNullSafe(ranges["id"]) & (marked["tie"] == ranges["of_tie"]), "left").select("row", "text", "ranges")
    schema = StructType(list(docs.schema.fields)).add(unused("__lines", docs.columns), "long").add(unused("__deleted", docs.columns), "long")
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 256):
                batch = whole.slice(first, 256)
                found = [without_ranges(t.as_py(), r.as_py()) for t, r in zip(batch.column(1), batch.column(2), strict=True)]
                columns = batch.column(0).flatten()
                columns.insert(at, pa.array([f[0] for f in found], pa.string()))
                yield pa.RecordBatch.from_arrays([*columns, pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int64())], names=schema.names)

    return joined.mapInArrow(run, schema)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` with their remaining text: (doc_id, n_lines, n_deleted, text)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", F.col("__lines").alias("n_lines"), F.col("__deleted").alias("n_deleted"), "text")
