"""Text expressions: paragraphs, mark-up, identifiers and labels, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Patterns and limits that decide results.
LEAST_PARAGRAPH_CHARS = 30
LONG_PARAGRAPH_CHARS = 2500
REFERENCE_CHARS = 400
REFERENCE_OPENING = r"^\s*(\[\d{1,3}\]|\\bibitem|\(\d{4}\))"
REFERENCE_SIGNALS = (r"\(\d{4}\)|\b(19|20)\d{2}\b", r"\bet al\b", r"\bpp\.|\bvol\.|\bno\.\s*\d", r"arXiv:", r"\bJ\.\s|\bProc\.|\bIEEE\b|\bACM\b")
INLINE_MATH = r"(?sU)(?<!\\)\$(?:((?:[\d.,]|[^\S\n]){1,200})|[^$\n]{0,200})(?<!\\)\$|\\\((?:([\d\s.,]{1,200})|.{0,200}?)\\\)"
SECTION_COMMAND = r"\\(?:chapter|(?:sub){0,2}section|paragraph)\s*\*?\s*\{([^}\n]{0,200})\}"
REFERENCE_LINE = r"(?m)^[ \t]*(\[\d{1,3}\]|\\bibitem)"
PARAGRAPH_BREAK = r"\n\s*\n|\\par\b"
BIBLIOGRAPHY = r"\\begin\s*\{thebibliography\}|\\bibliography\s*\{|\\printbibliography"
SECTION_MARK = "\u0000SEC:"
SECTION_END = "\u0000"


def strip(text: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return strip(F.regexp_replace(text, r"\s+", " "))


def span_array(json: Column) -> Column:
    """Spans of a JSON string, sorted; broken JSON and spans that are not ascending integers vanish."""
    parsed = F.from_json(json, "array<struct<start:int,end:int>>")
    whole = F.filter(F.coalesce(parsed, F.array()), lambda s: s["start"].isNotNull() & s["end"].isNotNull() & (s["end"] > s["start"]))
    return F.array_sort(whole)


def spans_to_paragraphs(text: Column, spans: Column, headers: Column) -> Column:
    """Array of (idx, start, end, text, section) of the paragraphs of a body with spans.

    ``idx`` counts before short paragraphs go; a section is the last header that starts at or before
    the paragraph.
    """
    cut = lambda s: strip(F.substring(text, s["start"] + 1, s["end"] - s["start"]))
    section = lambda s: F.try_element_at(F.filter(headers, lambda h: h["start"] <= s["start"]), F.lit(-1))
    made = F.transform(spans, lambda s, i: F.struct(i.alias("idx"), s["start"].alias("start"), s["end"].alias("end"), cut(s).alias("text"), F.when(section(s).isNotNull(), cut(section(s))).alias("section")))
    return F.filter(made, lambda p: F.length(p["text"]) >= LEAST_PARAGRAPH_CHARS)


def split_paragraphs(text: Column, separator: str, least_chars: int = LEAST_PARAGRAPH_CHARS) -> Column:
    """Array of (idx, text) of the stripped pieces between ``separator``; idx counts before the short
    ones go."""
    pieces = F.transform(F.split(text, separator), lambda p, i: F.struct(i.alias("idx"), strip(p).alias("text")))
    return F.filter(pieces, lambda p: F.length(p["text"]) >= least_chars)


def unwrap_math(text: Column) -> Column:
    """Inline mathematics: numbers stay without their mark-up, anything else becomes a space."""
    # One pass, since what stands between two formulas looks like one: numbers are kept between marks.
    marked = F.regexp_replace(text, INLINE_MATH, "\u0001$1$2\u0002")
    return F.translate(F.replace(marked, F.lit("\u0001\u0002"), F.lit(" ")), "\u0001\u0002", "")


def cut_bibliography(text: Column) -> Column:
    """The text up to the first bibliography command in its second half."""
    half = F.ceil(F.length(text) / 2).cast("int")
    before, after = F.substring(text, F.lit(1), half), F.substring(text, half + 1, F.length(text))
    return F.concat(before, F.split(after, BIBLIOGRAPHY, 2)[0])


def mark_sections(text: Column) -> Column:
    """Headings as marked paragraphs of their own, and every reference line as a paragraph."""
    marked = F.regexp_replace(text, SECTION_COMMAND, f"\n\n{SECTION_MARK}$1{SECTION_END}\n\n")
    return F.regexp_replace(marked, REFERENCE_LINE, "\n\n$1")


def looks_like_reference(text: Column) -> Column:
    """Opens like an entry of a reference list, or is short and has two tells of one."""
    tells = sum((F.when(text.rlike(p), 1).otherwise(0) for p in REFERENCE_SIGNALS), F.lit(0))
    return text.rlike(REFERENCE_OPENING) | ((F.length(text) < REFERENCE_CHARS) & (tells >= 2))


def split_long(text: Column, cap: int = LONG_PARAGRAPH_CHARS) -> Column:
    """Array of pieces of at most ``cap`` characters, packed from whole sentences; a single longer
    sentence stays whole."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"))

    def step(s: Column, sentence: Column) -> Column:
        full = (s["cur"] != "") & (F.length(s["cur"]) + F.length(sentence) + 1 > cap)
        joined = F.trim(F.concat(s["cur"], F.lit(" "), sentence))
        return F.struct(F.when(full, F.concat(s["out"], F.array(s["cur"]))).otherwise(s["out"]).alias("out"), F.when(full, sentence).otherwise(joined).alias("cur"))

    packed = F.aggregate(F.split(text, r"(?<=[.!?])\s+"), start, step, lambda s: F.when(s["cur"] != "", F.concat(s["out"], F.array(s["cur"]))).otherwise(s["out"]))
    return F.when(F.length(text) <= cap, F.array(text)).otherwise(packed)


def latex_paragraphs(sources: DataFrame, key: str, text: str) -> DataFrame:
    """Paragraphs (key, idx, start, end, text, section) of assembled LaTeX sources.

    Sections are carried forward to the paragraphs after them; long paragraphs are split; idx and
    offsets count before short and reference-like pieces go.  One window per source, whose length bounds
    the rows that meet.
    """
    plain = mark_sections(unwrap_math(cut_bibliography(F.col(text))))
    chunks = sources.select(key, F.posexplode(F.split(plain, PARAGRAPH_BREAK)).alias("at", "chunk")).withColumn("chunk", strip("chunk"))
    chunks = chunks.where(F.col("chunk") != "")
    heading = F.when(F.startswith("chunk", F.lit(SECTION_MARK)), strip(F.split(F.substring("chunk", 6, 1 << 30), SECTION_END, 2)[0]))
    rest = F.when(heading.isNotNull(), strip(F.coalesce(F.get(F.split(F.substring("chunk", 6, 1 << 30), SECTION_END, 2), F.lit(1)), F.lit("")))).otherwise(F.col("chunk"))
    order = Window.partitionBy(key).orderBy("at")
    carried = chunks.withColumn("heading", heading).withColumn("section", F.nullif(F.last("heading", ignorenulls=True).over(order), F.lit(""))).withColumn("body", collapse(F.translate(rest, "\u0000", " "))).where("body <> ''")
    pieces = carried.select(key, "at", "section", F.posexplode(split_long(F.col("body"))).alias("part", "text"))
    whole = Window.partitionBy(key).orderBy("at", "part")
    placed = pieces.withColumn("idx", (F.row_number().over(whole) - 1).cast("int")).withColumn("start", F.coalesce(F.sum(F.length("text") + 2).over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int"))
    kept = placed.where(F.length("text") >= LEAST_PARAGRAPH_CHARS).where(~looks_like_reference(F.col("text")))
    return kept.select(key, "idx", "start", (F.col("start") + F.length("text")).alias("end"), "text", "section")


# Archives whose old-style identifiers are known.
OLD_ARCHIVES = (
    "acc-phys", "adap-org", "alg-geom", "ao-sci", "astro-ph", "atom-ph", "bayes-an", "chao-dyn", "chem-ph", "cmp-lg", "comp-gas", "cond-mat", "cs", "dg-ga", "funct-an", "gr-qc",
    "hep-ex", "hep-lat", "hep-ph", "hep-th", "math", "math-ph", "mtrl-th", "nlin", "nucl-ex", "nucl-th", "patt-sol", "physics", "plasm-ph", "q-alg", "q-bio", "quant-ph", "solv-int", "supr-con",
)


def member_to_id(name: Column) -> Column:
    """Canonical paper id of an archive member's name, null where it has none."""
    stem = F.regexp_replace(F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"(\.gz)?(\.pdf)?(\.tar)?(\.abs)?$", ""), r"v\d+$", "")
    new = F.regexp_extract(stem, r"^(\d{4}\.\d{4,5})$", 1)
    archive, digits = F.regexp_extract(stem, r"^([a-z-]+(?:\.[A-Z]{2})?)(\d{7})$", 1), F.regexp_extract(stem, r"^([a-z-]+(?:\.[A-Z]{2})?)(\d{7})$", 2)
    known = F.split(archive, r"\.")[0].isin(*OLD_ARCHIVES)
    return F.when(new != "", new).when((archive != "") & known, F.concat(archive, F.lit("/"), digits))


def id_year(paper_id: Column) -> Column:
    """Year of an id, null for a month that is none; from 91 on the century is the last one."""
    digits = F.regexp_extract(F.element_at(F.split(paper_id, "/"), -1), r"^(\d{4})", 1)
    yy, mm = F.substring(digits, 1, 2).try_cast("int"), F.substring(digits, 3, 2).try_cast("int")
    return F.when(mm.between(1, 12), F.when(yy >= 91, 1900 + yy).otherwise(2000 + yy))


def id_month(paper_id: Column) -> Column:
    month = F.substring(F.regexp_extract(F.element_at(F.split(paper_id, "/"), -1), r"^(\d{4})", 1), 3, 2).try_cast("int")
    return F.when(month.between(1, 12), month)


def paper_key(paper_id: Column) -> Column:
    return F.concat(F.lit("arxiv:"), paper_id)


def archive_of(category: Column) -> Column:
    return F.split(category, r"\.")[0]


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def release_month(text: Column) -> Column:
    """'yyyy-MM' or 'yyyy' of a release cell: a full date, a month with year, a quarter (its first
    month) or a year."""
    iso = F.regexp_extract(text, r"\b((?:19|20)\d{2}-(?:0[1-9]|1[0-2]))(?:-\d{2})?\b", 1)
    named = F.regexp_extract(text, r"(?i)\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+(?:\d{1,2},?\s+)?((?:19|20)\d{2})\b", 1)
    named_year = F.regexp_extract(text, r"(?i)\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+(?:\d{1,2},?\s+)?((?:19|20)\d{2})\b", 1)
    number = F.array_position(F.array(*map(F.lit, ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"))), F.lower(named))
    quarter, quarter_year = F.regexp_extract(text, r"\bQ([1-4])\s+((?:19|20)\d{2})\b", 1), F.regexp_extract(text, r"\bQ([1-4])\s+((?:19|20)\d{2})\b", 2)
    year = F.regexp_extract(text, r"\b((?:19|20)\d{2})\b", 1)
    month = F.lpad(number.cast("string"), 2, "0")
    return F.when(iso != "", iso).when(named != "", F.concat(named_year, F.lit("-"), month)).when(quarter != "", F.concat(quarter_year, F.lit("-"), F.lpad(((quarter.try_cast("int") - 1) * 3 + 1).cast("string"), 2, "0"))).when(year != "", year)


def largest_number(text: Column) -> Column:
    """The largest number in a specification cell; thousands may have commas."""
    found = F.regexp_extract_all(F.regexp_replace(text, r"(?<=\d),(?=\d{3})", ""), F.lit(r"\d+(?:\.\d+)?"), F.lit(0))
    return F.array_max(F.transform(found, lambda x: x.cast("double")))


def prompt(section: Column, hints: Column, passage: Column) -> Column:
    return F.concat_ws("\n", F.concat(F.lit("Section: "), F.coalesce(section, F.lit("(unknown)"))), F.concat(F.lit("Hints: "), F.array_join(F.array_distinct(hints), ", ")), F.concat(F.lit("Passage: "), passage))


def embedding_text(title: Column, abstract: Column, separator: str = " [SEP] ") -> Column:
    return F.when(F.trim(F.coalesce(title, F.lit(""))) != "", F.concat(title, F.lit(separator), abstract)).otherwise(abstract)


def expand_shards(spec: Column) -> Column:
    """'0-3,7' as a sorted array of different integers."""
    parts = F.transform(F.split(spec, ","), lambda p: F.split(F.trim(p), "-"))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, lambda p: F.sequence(p[0].cast("int"), F.element_at(p, -1).cast("int"))))))


def model_tag(name: Column) -> Column:
    return F.lower(F.replace(F.element_at(F.split(name, "/"), -1), F.lit("."), F.lit("-")))


def version_parts(version: Column) -> Column:
    """A version as numbers, so that 0.10.0 is above 0.9.0."""
    return F.transform(F.split(version, r"\."), lambda x: x.try_cast("int"))
