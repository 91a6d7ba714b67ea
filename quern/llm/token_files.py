"""Token-id output: documents in ascending order of their ids, as grammar-compressed shard files.

A shard is one range of document ids.  Its file holds the documents (id and number of tokens), the
Re-Pair grammar of their ids, and marks for random access; see ``repair``.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from quern.llm import repair
from quern.llm.files import whole_file
from quern.llm.numbering import with_offsets
from quern.llm.storage import materialize, new_folder, small_batches

END_ID = 2
#: UTF-8 bytes of text in a shard, about.
SHARD_BYTES = 8_000_000
#: Ranges of ids that a table is cut into at most; the driver holds a sample of 100 keys for each.
MOST_RANGES = 20_000
#: Shards of one range are numbered within this many bits.
RANGE_BITS = 24
#: Parts of words whose ids a worker remembers, in each of two generations.
REMEMBERED = 300_000
#: Shards whose starts are summed by one task.
SHARDS_PER_CHUNK = 4096


class WordEncoder:
    """Ids of whole texts under a vocabulary that never joins across white space.

    The splitting pattern of such a vocabulary matches no white space, and none of its normalisers
    looks across it: the ids of a text are those of its white-space separated words, one after the
    other.  For the same reason a word that ends in a letter and then marks is the word and the marks,
    and a text of words that are letters alone falls apart at the tokens that end a word.  The library
    encodes every word or part once while it is remembered.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # Small and capital letters of ASCII are one only under a vocabulary that folds case.
        self.folds = self.tokenizer.encode(CAPITALS, add_special_tokens=False).ids == self.tokenizer.encode(CAPITALS.lower(), add_special_tokens=False).ids
        # A word of small letters of ASCII that nothing rewrites or parts goes straight to the model.
        small = CAPITALS.lower()
        self.words = self.tokenizer
        if (self.tokenizer.normalizer is None or self.tokenizer.normalizer.normalize_str(small) == small) and [w for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(small)] == [small]:
            self.words = Tokenizer(self.tokenizer.model)
            self.words.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.special = "|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())
        vocabulary = self.tokenizer.get_vocab()
        self.base = max(vocabulary.values()) + 1
        self.kind = "<u2" if self.base < 1 << 16 else "<u4"
        self.ends = np.zeros(self.base, bool)
        self.ends[[n for token, n in vocabulary.items() if token.endswith("</w>")]] = True
        self.parts = Remembered()

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text (null: none)."""
        listed = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        words = listed.flatten().dictionary_encode()
        different = words.dictionary
        # Words that hold a special token are looked up as they stand: its case counts, and it parts a word.
        special = pc.match_substring_regex(different, self.special) if self.special else None
        folded = pc.ascii_lower(different) if self.folds else different
        stopped = pc.extract_regex(folded, STOPPED)
        if special is not None and pc.any(special).as_py():
            folded = pc.if_else(special, different, folded)
            stopped = pc.if_else(special, pa.scalar(None, stopped.type), stopped)
        different, found = folded, stopped
        cores = pc.coalesce(pc.struct_field(found, "core"), different).dictionary_encode()
        tails = pc.coalesce(pc.struct_field(found, "tail"), pa.scalar("", pa.large_string())).dictionary_encode()
        parts = cores.dictionary.to_pylist() + tails.dictionary.to_pylist()
        values = self.parts.of(parts, self._encode_parts)
        table = np.frombuffer(b"".join(values), self.kind)
        lengths = np.fromiter(map(len, values), np.int32, len(values)) // table.itemsize
        # Every word is its core and its tail, both looked up in the table.
        number = words.indices.to_numpy()
        codes = np.empty(2 * len(number), np.int32)
        codes[0::2] = cores.indices.to_numpy()[number]
        codes[1::2] = tails.indices.to_numpy()[number] + len(cores.dictionary)
        sizes = lengths[codes]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        shift = (np.cumsum(lengths) - lengths)[codes] - ends[:-1]
        kind = np.int32 if max(int(ends[-1]), len(table)) < 1 << 31 else np.int64
        ids = table[np.repeat(shift.astype(kind), sizes) + np.arange(ends[-1], dtype=kind)]
        self.parts.turn()
        offsets = listed.offsets.to_numpy()
        return np.split(ids, ends[2 * (offsets - offsets[0])[1:-1]]) if len(texts) else []

    def _encode_parts(self, parts: list[str]) -> list[bytes]:
        out: dict[str, bytes] = {"": b""}
        small = [p for p in parts if p.isascii() and p.isalpha() and p.islower()]
        other = [p for p in parts if not p.isascii() and p.isalpha() and unicodedata.normalize("NFC", p.lower()).isalpha()]
        for tokenizer, plain in ((self.words, small), (self.tokenizer, other)):
            for at in range(0, len(plain), 1024):
                some = plain[at : at + 1024]
                ids = np.array(tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, self.kind)
                ends = np.nonzero(self.ends[ids])[0] + 1
                if len(ends) == len(some):
                    data, width = ids.tobytes(), ids.itemsize
                    places = [0, *(ends * width).tolist()]
                    out.update((p, data[a:b]) for p, a, b in zip(some, places, places[1:], strict=False))
        rest = [p for p in parts if p not in out]
        for at in range(0, len(rest), 4096):
            some = rest[at : at + 4096]
            found = self.tokenizer.encode_batch_fast(some, add_special_tokens=False)
            out.update((p, np.array(e.ids, self.kind).tobytes()) for p, e in zip(some, found, strict=True))
        return [out[p] for p in parts]


CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A word that ends in a letter before marks of ASCII (but the apostrophe, which shortened words need): two parts.
STOPPED = r"^(?P<core>.*?\pL)(?P<tail>[!-&(-/:-@\[-`{-~]+)$"


class Remembered:
    """Values by key, in two generations: what was not asked for lately is forgotten."""

    def __init__(self, most: int = REMEMBERED):
        self.most, self.young, self.old = most, {}, {}

    def of(self, keys: list[str], make) -> list[bytes]:
        """The values of ``keys``; what is not remembered is made, each once."""
        values = list(map(self.young.get, keys))
        missing = [k for k, value in enumerate(values) if value is None]
        if missing:
            fresh = []
            for k in missing:
                values[k] = value = self.old.get(keys[k])
                if value is None:
                    fresh.append(k)
            if fresh:
                for k, value in zip(fresh, make([keys[k] for k in fresh]), strict=True):
                    values[k] = value
            self.young.update((keys[k], values[k]) for k in missing)
        return values

    def turn(self) -> None:
        if len(self.young) > self.most:
            self.young, self.old = {}, self.young


@lru_cache(maxsize=1)
def load_encoder(path: str | None) -> WordEncoder:
    import public_tokenizers

    return WordEncoder(path or public_tokenizers.path("word_bpe_49k.json"))


def _by_bytes(parts: Iterator[pa.Array], most: int = 12_000_000) -> Iterator[pa.Array]:
    """The texts of all parts, put together to about ``most`` bytes at a time."""
    held, size = [], 0
    for texts in parts:
        held.append(texts)
        size += texts.nbytes
        if size >= most:
            yield pa.concat_arrays(held)
            held, size = [], 0
    if held:
        yield pa.concat_arrays(held)


def write_token_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES, folder: str | None = None) -> str:
    """Encode every whole text, append ``end_id``, write shard files; returns their folder.

    Shards are ranges of ids, and one id in many rows fills as many shards as it needs; nulls come first,
    and rows of one id in a shard follow a hash of the text.  A null text is empty and has the end id alone.
    An empty table gives one shard without documents.  A task has one range, of about ``shard_bytes`` of
    text or, in tables of more than MOST_RANGES of these, as many shards as it needs one after the other.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "token-shards")
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    small_batches(spark)
    # The tie of the ranges must cost no text: they are sampled before they are dealt.
    slim = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), F.monotonically_increasing_id().alias("tie"))
    ranges = slim.repartitionByRange(max(1, min(MOST_RANGES, -(-total // shard_bytes))), "id", "tie").drop("tie").sortWithinPartitions("id", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, keys, counts, parts = load_encoder(vocabulary), [], [], []
        end = np.array([end_id], np.int32)

        def texts_of() -> Iterator[pa.Array]:
            for batch in batches:
                keys.append(batch.column(0))
                yield batch.column(1)

        def written(shard: int) -> pa.RecordBatch:
            ids = np.concatenate(parts, dtype=np.int32) if parts else np.empty(0, np.int32)
            parts.clear()
            table = pa.table({"id": pa.chunked_array(keys) if keys else pa.array([], pa.int64()), "n_tokens": pa.array(counts, pa.int64())})
            keys.clear()
            counts.clear()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as writer:
                writer.write_table(table)
            data = repair.pack(repair.compress(ids, max(encoder.base, end_id + 1)), sink.getvalue().to_pybytes())
            with whole_file(folder, f"shard-{shard:012d}.qrp") as stream:
                stream.write(data)
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([len(data)], pa.int64())], names=["shard", "n_ids", "n_bytes"])

        shard, size = TaskContext.get().partitionId() << RANGE_BITS, 0
        first = shard
        for texts in _by_bytes(texts_of(), shard_bytes * 3 // 2):
            for ids in encoder.encode(texts):
                counts.append(len(ids) + 1)
                parts += [ids, end]
            # A range holds about one shard where there are few; up to twice of that is no reason to cut.
            size += texts.nbytes
            if size >= 2 * shard_bytes:
                yield written(shard)
                shard, size = shard + 1, 0
        if keys or shard == first:
            yield written(shard)

    ranges.mapInArrow(run, "shard long, n_ids long, n_bytes long").agg(F.count("*")).collect()
    return folder


def read_token_shards(spark: SparkSession, folder: str, id_type: str = "bigint", with_ids: bool = False) -> DataFrame:
    """Documents of the files: (id, shard, at, n_tokens, ids_crc32[, ids]).

    ``at`` counts the ids of the shard before the document; ids_crc32 is over its ids as little-endian
    unsigned 32-bit integers.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.qrp").load(folder).select(F.regexp_extract("path", r"shard-(\d+)\.qrp$", 1).cast("long").alias("shard"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                grammar, documents = repair.unpack(content.as_py())
                table = pa.ipc.open_stream(documents).read_all()
                counts = table.column("n_tokens").to_numpy()
                ids = grammar.ids().astype("<u4")
                ends = np.cumsum(counts)
                starts = ends - counts
                sums = [zlib.crc32(ids[s:e].tobytes()) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                columns = [table.column("id").combine_chunks(), pa.array(np.full(len(counts), shard, np.int64)), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(sums, pa.int64())]
                names = ["id", "shard", "at", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([ids[s:e].astype(np.int64) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)], pa.list_(pa.int64())))
                    names.append("ids")
                if len(counts):
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"id {id_type}, shard long, at long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return files.mapInArrow(run, schema)


def token_index(spark: SparkSession, folder: str, id_type: str = "bigint") -> DataFrame:
    """Rows (id, start, n_tokens, ids_crc32) read from the files; ``start`` counts the ids of all
    documents before it over all shards."""
    found = materialize(read_token_shards(spark, folder, id_type), "token-index")
    totals = found.groupBy("shard").agg(F.sum("n_tokens").alias("n")).withColumn("one", F.lit(0)).withColumn("chunk", F.floor(F.col("shard") / SHARDS_PER_CHUNK).cast("int"))
    starts = with_offsets(totals, "one", "chunk", [F.col("shard")], "n", "shard_start").select("shard", "shard_start")
    return found.join(starts, "shard").select("id", (F.col("shard_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` encoded into shard files and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    key = docs.schema["doc_id"].dataType.simpleString()
    return token_index(spark, write_token_shards(docs), key).withColumnRenamed("id", "doc_id")
