"""Quality rules as a short-circuit cascade.

A document is rejected by the first rule that fires, so the order of the rules decides what a
verdict costs but never what it is.  Each rule is timed and its rejections are counted on a small
sample of the corpus; rules then run by falling rejection per second.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quern.llm.storage import small_batches
from quern.llm.words import WHITE_SPACE, encoded_words

SYMBOLS = "#*$%&|<>"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rows of the sample that the order of the rules is estimated on, about.
SAMPLE_ROWS = 1000


class TextFacts:
    """Measures of one text, each computed when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        return encoded_words(self.text)

    @property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, WHITE_SPACE))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        """Lines that hold a word."""
        return [line for line in self.text.split("\n") if line.strip(WHITE_SPACE)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words that lie in a window of five words found at least twice in the text."""
        w = self.words
        windows = list(zip(w, w[1:], w[2:], w[3:], w[4:], strict=False))
        if len(set(windows)) == len(windows):
            return 0
        found, covered, upto = Counter(windows), 0, 0
        for at, window in enumerate(windows):
            if found[window] > 1:
                covered += at + 5 - max(at, upto)
                upto = at + 5
        return covered

    @cached_property
    def upper_share(self) -> float:
        """Capitals among the letters A-Z and a-z."""
        data = self.text.encode("utf-8", "surrogatepass")
        upper = len(data) - len(data.translate(None, CAPITALS))
        lower = len(data) - len(data.translate(None, CAPITALS.lower()))
        return upper / max(1, upper + lower)

    @cached_property
    def long_word_share(self) -> float:
        """Share of the word characters in words of over 40 bytes."""
        return sum(len(w) for w in self.words if len(w) > 40) / max(1, sum(map(len, self.words)))


@dataclass(frozen=True)
class Rule:
    """``rejects`` is true for texts that go."""

    name: str
    rejects: Callable[[TextFacts], bool]


def _few_words(f: TextFacts) -> bool:
    return f.n_words < 10


def _repeated_words(f: TextFacts) -> bool:
    return 100 * f.n_repeat_words > 20 * f.n_words


def _symbols(f: TextFacts) -> bool:
    return 10 * f.n_symbols > f.n_words


def _duplicate_lines(f: TextFacts) -> bool:
    return 10 * f.n_dup_lines > 3 * len(f.lines)


def _shouting(f: TextFacts) -> bool:
    return f.n_words >= 10 and f.upper_share > 0.3


def _word_length(f: TextFacts) -> bool:
    return f.n_words > 0 and not 2 * f.n_words <= f.word_chars <= 20 * f.n_words


def _unbroken(f: TextFacts) -> bool:
    return f.long_word_share > 0.3


#: The two rules of the base verdict.
BASE_RULES = (Rule("few_words", _few_words), Rule("repeated_words", _repeated_words))
#: The rules that the cascade adds.
CASCADE_RULES = (
    Rule("symbols", _symbols),
    Rule("duplicate_lines", _duplicate_lines),
    Rule("shouting", _shouting),
    Rule("word_length", _word_length),
    Rule("unbroken", _unbroken),
)


def order_rules(docs: DataFrame, rules: tuple[Rule, ...], text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> tuple[Rule, ...]:
    """``rules`` by falling rejections per second, as measured on about ``sample_rows`` documents.

    The sample is spread over the whole table and drawn by row; only one line per rule comes back to
    the driver.  An empty table leaves the order as it is.
    """
    small_batches(docs.sparkSession)
    rows = docs.count()
    sample = docs.select(F.col(text_col).alias("text"))
    if rows > sample_rows:
        sample = sample.sample(fraction=sample_rows / rows, seed=7)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seconds, rejected, seen = [0.0] * len(rules), [0] * len(rules), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen += 1
                for k, rule in enumerate(rules):
                    facts = TextFacts(text)  # anew: the cost of a rule includes what it reads
                    began = time.perf_counter()
                    rejected[k] += bool(rule.rejects(facts))
                    seconds[k] += time.perf_counter() - began
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(rules)), pa.int32()), pa.array(seconds), pa.array(rejected, pa.int64())], names=["rule", "seconds", "rejected"])

    found = sample.mapInArrow(measure, "rule int, seconds double, rejected long").groupBy("rule").agg(F.sum("seconds").alias("s"), F.sum("rejected").alias("n")).collect()
    gain = {row["rule"]: row["n"] / max(row["s"], 1e-9) for row in found}
    return tuple(rules[k] for k in sorted(range(len(rules)), key=lambda k: (-gain.get(k, 0.0), k)))


def first_rejection(facts: TextFacts, rules: tuple[Rule, ...]) -> str | None:
    return next((rule.name for rule in rules if rule.rejects(facts)), None)


def filter_documents(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = BASE_RULES + CASCADE_RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs``, all columns, that no rule rejects.

    A null text has no words and is judged as an empty one.  Repeated rows share their verdict.  The
    filter is narrow: no shuffle, and a document is judged wherever it is read.
    """
    ordered = order_rules(docs, rules, text_col, sample_rows)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [first_rejection(TextFacts(text), ordered) is None for text in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Base measures and both verdicts of every document.

    Rows (id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept).
    ``kept`` is false where the base fails, else the verdict of the cascade.  A null text is an empty
    one: all counts 0, base_failed true.  Ids are carried as they are, null and repeated ones too.
    """
    ordered = order_rules(docs, CASCADE_RULES, text_col, sample_rows)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, failed, kept = [[] for _ in names], [], []
            for text in batch.column(1).to_pylist():
                facts = TextFacts(text)
                for values, name in zip(counts, names, strict=True):
                    values.append(getattr(facts, name))
                failed.append(any(rule.rejects(facts) for rule in BASE_RULES))
                kept.append(not failed[-1] and first_rejection(facts, ordered) is None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(v, pa.int64()) for v in counts), pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_())], names=["id", *names, "base_failed", "kept"]
            )

    key = docs.schema[id_col].dataType.simpleString()
    schema = f"id {key}, " + ", ".join(f"{n} long" for n in names) + ", base_failed boolean, kept boolean"
    out = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, schema)
    return out.withColumnsRenamed({"id": id_col})


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdicts of all ``documents``; see ``quality_report``."""
    return quality_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The measures, the two base rules and the five of the cascade over whole texts.
OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
parts AS (
  SELECT r, doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
placed AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM parts),
windows AS (
  SELECT r, i, lead(word, 4) OVER o AS fifth, concat_ws(' ', word, lead(word) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o) AS five FROM placed WINDOW o AS (PARTITION BY r ORDER BY i)),
again AS (SELECT r, i FROM windows WHERE fifth IS NOT NULL QUALIFY count(*) OVER (PARTITION BY r, five) > 1),
repeated AS (SELECT r, count(DISTINCT i + k) AS n FROM again, range(5) AS x(k) GROUP BY r),
facts AS (
  SELECT doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS upper, length(t) - length(regexp_replace(t, '[a-z]', '', 'g')) AS lower,
         coalesce(list_sum(list_transform(list_filter(w, lambda x: strlen(x) > 40), lambda x: strlen(x))), 0) AS long_bytes, coalesce(list_sum(list_transform(w, lambda x: strlen(x))), 0) AS all_bytes
  FROM parts LEFT JOIN repeated USING (r)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM facts)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * n_lines OR upper / greatest(1, upper + lower)::DOUBLE > 0.3::DOUBLE OR word_chars NOT BETWEEN 2 * n_words AND 20 * n_words OR long_bytes / greatest(1, all_bytes)::DOUBLE > 0.3::DOUBLE) AS kept
FROM judged"""
