"""Tables of HTML pages as rows, and their columns as specifications."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quern.functions.text import largest_number, strip

# Cells that say that a value is not known.
UNKNOWN_CELL = r"(?i)^(nan|unknown|\?|—|–|-|n/a|tba|tbd)$"
FOOTNOTE = r"\[[^\]]*\]"
MOST_SPAN = 1000
#: Pages whose rows leave together, and rows after which they leave earlier.
PAGES_AT_ONCE, ROWS_AT_ONCE = 256, 1000


def _span(value: str | None) -> int:
    """A colspan or rowspan: its digits, 1 where it has none or they are 0."""
    digits = re.sub(r"\D", "", value or "")[:4]
    return min(max(int(digits or 1), 1), MOST_SPAN)


class _Reader(HTMLParser):
    """Collects (section, heading, head rows, body rows) of the tables; cells that span repeat."""

    def __init__(self, css: str | None) -> None:
        super().__init__(convert_charrefs=True)
        self.css, self.tables, self.open = css, [], []
        self.titles = {"h2": "", "h3": "", "h4": ""}
        self.title: str | None = None
        self.words: list[str] = []
        self.skip = 0

    def handle_starttag(self, tag, attrs) -> None:
        if tag in self.titles:
            self.title, self.words = tag, []
        elif tag in ("script", "style"):
            self.skip += 1
        elif tag == "table":
            wanted = self.css is None or self.css in (dict(attrs).get("class") or "").split()
            low = self.titles["h4"] or self.titles["h3"]
            self.open.append({"wanted": wanted, "section": self.titles["h2"], "heading": low, "rows": [], "cell": None})
        elif self.open and tag in ("tr", "td", "th"):
            self._close_cell()
            table = self.open[-1]
            if tag == "tr":
                table["rows"].append([])
            else:
                a = dict(attrs)
                table["cell"] = [tag == "th", _span(a.get("colspan")), _span(a.get("rowspan")), []]

    def handle_endtag(self, tag) -> None:
        if tag == self.title:
            self.titles[tag] = " ".join("".join(self.words).split())
            for below in [t for t in self.titles if t > tag]:
                self.titles[below] = ""
            self.title = None
        elif tag in ("script", "style"):
            self.skip = max(self.skip - 1, 0)
        elif self.open and tag in ("td", "th", "tr", "table"):
            self._close_cell()
            if tag == "table":
                self._finish(self.open.pop())

    def handle_data(self, data) -> None:
        if self.skip:
            return
        if self.title:
            self.words.append(data)
        elif self.open and self.open[-1]["cell"]:
            self.open[-1]["cell"][3].append(data)

    def _close_cell(self) -> None:
        table = self.open[-1]
        if table["cell"]:
            if not table["rows"]:
                table["rows"].append([])
            table["rows"][-1].append(table["cell"])
            table["cell"] = None

    def _finish(self, table: dict) -> None:
        if not table["wanted"]:
            return
        grid: list[tuple[bool, list[str]]] = []
        down: dict[int, tuple[int, str]] = {}
        for cells in table["rows"]:
            row: list[str] = []
            for _, wide, high, parts in cells:
                self._carry(row, down)
                text = " ".join("".join(parts).split())
                for _ in range(wide):
                    if high > 1:
                        down[len(row)] = (high - 1, text)
                    row.append(text)
            self._carry(row, down)
            if row:
                grid.append((all(c[0] for c in cells) and bool(cells), row))
        heads = 0
        while heads < len(grid) and grid[heads][0]:
            heads += 1
        width = max((len(r) for _, r in grid), default=0)
        names = [[r[k] for _, r in grid[:heads] if k < len(r)] for k in range(width)]
        header = [" ".join(dict.fromkeys(n for n in column if n)) for column in names]
        self.tables.append((table["section"], table["heading"], header, [r for _, r in grid[heads:]]))

    @staticmethod
    def _carry(row: list[str], down: dict[int, tuple[int, str]]) -> None:
        while len(row) in down:
            left, text = down.pop(len(row))
            if left > 1:
                down[len(row)] = (left - 1, text)
            row.append(text)

    def close(self) -> None:
        super().close()
        while self.open:
            self._close_cell()
            self._finish(self.open.pop())


def table_rows(pages: DataFrame, key: str, html: str, css: str | None = None) -> DataFrame:
    """(key, table, section, heading, header, row, cells) of every row below the head of every table.

    ``css`` keeps tables of one class.  Section and heading are the last h2 and the last h3 or h4 before
    the table.  A head of several rows is joined by column.  A null page has no row; broken spans count
    as one, tables left open end with the page.  One page and about ROWS_AT_ONCE rows are in memory."""
    kind = pages.schema[key].dataType.simpleString()
    fields = (("table", pa.int32()), ("section", pa.string()), ("heading", pa.string()), ("header", pa.list_(pa.string())), ("row", pa.int32()), ("cells", pa.list_(pa.string())))

    def made(batch: pa.RecordBatch, ats: list[int], rows: list[tuple]) -> pa.RecordBatch:
        keys = batch.column(0).take(pa.array(ats))
        return pa.RecordBatch.from_arrays([keys, *[pa.array(c, f[1]) for c, f in zip(zip(*rows, strict=True), fields, strict=True)]], names=[key, *[f[0] for f in fields]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for start in range(0, batch.num_rows, PAGES_AT_ONCE):
                ats: list[int] = []
                rows: list[tuple] = []
                for at in range(start, min(start + PAGES_AT_ONCE, batch.num_rows)):
                    text = texts[at].as_py()
                    if text is None or "<table" not in text.lower():
                        continue
                    reader = _Reader(css)
                    reader.feed(text)
                    reader.close()
                    before = len(rows)
                    rows += [(t, s, h, head, r, cells) for t, (s, h, head, body) in enumerate(reader.tables) for r, cells in enumerate(body)]
                    ats += [at] * (len(rows) - before)
                    if len(rows) >= ROWS_AT_ONCE:
                        yield made(batch, ats, rows)
                        ats, rows = [], []
                if rows:
                    yield made(batch, ats, rows)

    return pages.select(key, html).mapInArrow(run, f"{key} {kind}, table int, section string, heading string, header array<string>, row int, cells array<string>")


def column_kind(header: Column) -> Column:
    """(field, factor) of a column by its header, null where it is no specification.

    Tensor and matrix columns come first, since their headers may name an accumulator's format; sparse
    and ray-tracing rates are none.  Rates are GFLOPS, memory GB, power W."""
    name = F.lower(header)
    kind = lambda field, factor: F.struct(F.lit(field).alias("field"), factor.alias("factor"))
    rate = name.rlike("processing power|tflops|gflops")
    flops = F.when(name.contains("tflops"), 1000.0).otherwise(1.0)
    wide = name.rlike("tensor|matrix")
    size = F.when(name.rlike(r"\(mi?b"), 1 / 1024).otherwise(1.0)
    return (
        F.when(rate & name.rlike("sparse|ray tracing|speedup"), None)
        .when(rate & wide & name.rlike("dense|tensor core|fp16|bf16|half"), kind("fp16_tensor_gflops", flops))
        .when(rate & wide, None)
        .when(rate & name.rlike(r"\b(single|fp32)\b"), kind("fp32_gflops", flops))
        .when(rate & name.rlike(r"\b(double|fp64)\b"), kind("fp64_gflops", flops))
        .when(rate & name.contains("vector") & ~name.rlike("fp16|bf16|int"), kind("fp32_gflops", flops))
        .when(rate, None)
        .when(name.contains("memory") & name.contains("size"), kind("vram_gb", size))
        .when(name.contains("tdp"), kind("tdp_w", F.lit(1.0)))
    )


def cell_value(cell: Column, factor: Column) -> Column:
    """The largest number of a cell, scaled; null for cells that say that it is not known."""
    plain = strip(F.regexp_replace(F.regexp_replace(cell, FOOTNOTE, " "), r"\x{a0}", " "))
    return F.when(~plain.rlike(UNKNOWN_CELL), F.round(largest_number(plain) * factor, 3))


def specifications(rows: DataFrame, key: str) -> DataFrame:
    """One row per table row with a name: the first column for each specification and for the name
    (header with 'model' or 'name', else the first column)."""
    columns = F.transform("header", lambda h, i: F.struct(i.alias("i"), h.alias("h"), column_kind(h).alias("k")))
    named = F.filter("columns", lambda c: F.lower(c["h"]).rlike(r"\b(model|name)\b"))
    picked = rows.withColumn("columns", columns).withColumn("at", F.coalesce(F.get(named, F.lit(0))["i"], F.lit(0)))

    def value(field: str) -> Column:
        c = F.get(F.filter("columns", lambda x: x["k"]["field"] == field), F.lit(0))
        return cell_value(F.get("cells", c["i"]), c["k"]["factor"]).alias(field)

    fields = ("fp32_gflops", "fp64_gflops", "fp16_tensor_gflops", "vram_gb", "tdp_w")
    out = picked.select(key, "table", "row", "section", "heading", strip(F.regexp_replace(F.get("cells", "at"), FOOTNOTE, "")).alias("name"), *map(value, fields))
    return out.where("name <> ''")


def repaired_spans(html: Column) -> Column:
    """HTML whose quoted colspan and rowspan hold digits only, 1 where they had none."""
    digits = F.regexp_replace(html, r'(?i)\b(colspan|rowspan)\s*=\s*"[^"0-9]*(\d+)[^"0-9]*"', '$1="$2"')
    return F.regexp_replace(digits, r'(?i)\b(colspan|rowspan)\s*=\s*"[^"0-9]*"', '$1="1"')


def taxonomy(headings: list[tuple[str, str]]) -> tuple[dict[str, list[str]], dict[str, str]]:
    """(archives of each group, display name of each category) from (tag, text) of a page's headings: an
    h2 opens a group, an h4 reads 'code (Name)'."""
    groups: dict[str, list[str]] = {}
    names: dict[str, str] = {}
    here: list[str] | None = None
    for tag, text in headings:
        if tag == "h2":
            ignored = text.lower().startswith(("classification", "group name"))
            here = None if ignored else groups.setdefault(text, [])
        elif here is not None and (m := re.match(r"(\S+)[^(]*\((.*)\)", text)):
            names[m[1]] = m[2].strip()
            if (archive := m[1].split(".")[0]) not in here:
                here.append(archive)
    return groups, names


def headings(html: str) -> list[tuple[str, str]]:
    """(tag, text) of the h2 and h4 of one page, in order."""
    found = re.findall(r"(?is)<(h2|h4)\b[^>]*>(.*?)</\1>", html)
    return [(tag.lower(), " ".join(re.sub(r"<[^>]*>", " ", text).split())) for tag, text in found]
