"""Byte-level BPE encoding and decoding by monoid tree reduction.

A text is halved until its parts are small, every part is encoded alone, and neighbours are joined
on the way up: a window around the seam is encoded again and replaces the tokens that it covers.
The window is grown until both of its ends lie on a *settled* position: one where a character that
is no white space is followed by white space.  No alternative of the splitting pattern reads white
space after another character, and none looks back, so every settled position bounds a match
whatever stands on its either side; tokens outside of the window are then those of the whole text.
Encoding is a homomorphism over texts cut at settled positions, which makes the join associative.
Decoding joins the bytes of the halves up the same tree.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quern.llm.storage import small_batches

#: Characters of a part that is encoded without being halved further.
LEAF_CHARS = 4096
#: First window on either side of a seam; it doubles until it reaches a settled position.
WINDOW_CHARS = 32
#: White space in a row that the library is not given; the class is the pattern's.
MOST_SPACE = 10_000
LONG_SPACE = re.compile(r"[^\S\x1c-\x1f]{%d,}" % MOST_SPACE)


class TreeCodec:
    """Encoder and decoder over one vocabulary; ``encode_part`` is any exact encoder of whole texts."""

    def __init__(self, encode_part, token_bytes: list[bytes], leaf_chars: int = LEAF_CHARS):
        self.encode_part = encode_part
        self.token_bytes = token_bytes
        self.leaf_chars = max(2, leaf_chars)

    def encode(self, text: str) -> list[int]:
        return self._encode(text, 0, len(text))

    def _encode(self, text: str, low: int, high: int) -> list[int]:
        if high - low <= self.leaf_chars:
            return self.encode_part(text[low:high])
        middle = (low + high) // 2
        start, end = _settled_before(text, low, middle), _settled_after(text, middle, high)
        if 2 * (middle - start) > middle - low or 2 * (end - middle) > high - middle:
            # The window takes most of a half, whose own tokens would go again: only what is outside is halved.
            outside = [self._encode(text, a, b) if a < b else [] for a, b in ((low, start), (end, high))]
            return outside[0] + self.encode_part(text[start:end]) + outside[1]
        return self.join(text, low, middle, high, self._encode(text, low, middle), self._encode(text, middle, high))

    def join(self, text: str, low: int, middle: int, high: int, left: list[int], right: list[int]) -> list[int]:
        """Tokens of text[low:high] from those of its two parts."""
        start, end = _settled_before(text, low, middle), _settled_after(text, middle, high)
        if start == middle or end == middle:
            return left + right
        gone = len(self.encode_part(text[start:middle])) if start > low else len(left)
        cut = len(self.encode_part(text[middle:end])) if end < high else len(right)
        return left[: len(left) - gone] + self.encode_part(text[start:end]) + right[cut:]

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= self.leaf_chars:
            return b"".join(map(self.token_bytes.__getitem__, ids))
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


def _is_settled(text: str, at: int) -> bool:
    return text[at].isspace() and not text[at - 1].isspace() and text[at] not in _UNSURE and text[at - 1] not in _UNSURE


#: Python counts these four as white space and the pattern doesn't: no seam relies on them.
_UNSURE = "\x1c\x1d\x1e\x1f"


def _settled_before(text: str, low: int, middle: int) -> int:
    """The last settled position in (low, middle], or low."""
    if middle < len(text) and middle > low and _is_settled(text, middle):
        return middle
    width, stop = WINDOW_CHARS, middle
    while stop > low + 1:
        first = max(low + 1, middle - width)
        for at in range(stop - 1, first - 1, -1):
            if _is_settled(text, at):
                return at
        stop, width = first, width * 2
    return low


def _settled_after(text: str, middle: int, high: int) -> int:
    """The first settled position in [middle, high), or high."""
    width, start = WINDOW_CHARS, middle
    while start < high:
        last = min(high, middle + width)
        for at in range(start, last):
            if at and _is_settled(text, at):
                return at
        start, width = last, width * 2
    return high


@lru_cache(maxsize=2)
def load_codec(ranks_path: str, pattern: str, leaf_chars: int = LEAF_CHARS) -> TreeCodec:
    """The codec of a rank file, one per worker process."""
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    encoding = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode_part(text: str) -> list[int]:
        """The library overflows its stack on long runs of white space, so these are cut by the rule of
        the pattern: all of a run but its last character is one match where something follows."""
        ids, at = [], 0
        for run in LONG_SPACE.finditer(text) if len(text) > MOST_SPACE else ():
            stop = run.end() - (run.end() < len(text))
            ids += encoding.encode_ordinary(text[at : run.start()]) + encoding._encode_single_piece(text[run.start() : stop])
            at = stop
        return ids + encoding.encode_ordinary(text[at:])

    token_bytes = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        token_bytes[rank] = token
    return TreeCodec(encode_part, token_bytes, leaf_chars)


def _vocabulary(ranks: str | None) -> tuple[str, str]:
    """Resolved on the executor, where the vocabulary package is installed."""
    import public_tokenizers

    return ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """Rows (id, ids array<int>) with the tokens of every whole text.

    A null text counts as empty and gives an empty array; null and repeated ids are carried as they
    are; other columns are not read.  One narrow stage without a shuffle: a document is the unit of
    work, so hot sources and copies cost no more than their own length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load_codec(*_vocabulary(ranks_path), leaf_chars)
        for part in _small(batches):
            ids = [codec.encode(text or "") for text in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["id", "ids"])

    small_batches(docs.sparkSession)
    key = docs.schema[id_col].dataType.simpleString()
    out = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {key}, ids array<int>")
    return out.withColumnsRenamed({"id": id_col})


def decode_documents(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", ranks_path: str | None = None, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """Rows (id, content binary): the bytes that the tokens stand for (null tokens: none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load_codec(*_vocabulary(ranks_path), leaf_chars)
        for part in _small(batches):
            content = [codec.decode(ids or []) for ids in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(content, pa.binary())], names=["id", "content"])

    small_batches(encoded.sparkSession)
    key = encoded.schema[id_col].dataType.simpleString()
    out = encoded.select(encoded[id_col].alias("id"), encoded[ids_col].alias("ids")).mapInArrow(run, f"id {key}, content binary")
    return out.withColumnsRenamed({"id": id_col})


def encode_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """Encode and decode every whole text and keep what identifies the result.

    Rows (id, n_tokens long, ids_sha256 string, decoded_sha256 string): the ids as decimals joined
    by one space, and the bytes that decoding those ids gives, both as lower-case hex SHA-256.  Null
    and empty texts have no tokens and the digests of no bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load_codec(*_vocabulary(ranks_path), leaf_chars)
        decimal = [str(n) for n in range(len(codec.token_bytes))]
        for part in _small(batches):
            counts, of_ids, of_bytes = array("q"), [], []
            for text in part.column(1).to_pylist():
                ids = codec.encode(text or "")
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(" ".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                of_bytes.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_bytes)], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    small_batches(docs.sparkSession)
    key = docs.schema[id_col].dataType.simpleString()
    schema = f"id {key}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    out = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, schema)
    return out.withColumnsRenamed({"id": id_col})


def _small(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, so that the Python objects of a batch stay small beside its buffers."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` encoded and decoded; see ``encode_digests``."""
    return encode_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
