"""Aliases of devices, made from their names by one rule for every source.

A spelling of several words or of six characters or more is an alias as it stands.  A shorter one, a bare
code, is an alias behind a gate of context unless it is all digits, has a common other meaning, or belongs
to another device already.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quern.functions.text import collapse, slug

# Bare codes that mean something else in papers (hormones, vertebrae, norms, water, aircraft).
DENIED_CODES = ("T4", "L2", "L4", "A2", "H20", "MI6", "MI8", "A10", "C60", "P4")
# First words that make the rest of an alias safe in any case.
VENDOR_WORDS = (
    "nvidia", "amd", "ati", "intel", "google", "apple", "huawei", "aws", "amazon", "microsoft", "meta", "cambricon", "baidu",
    "metax", "biren", "sunway", "hygon", "alibaba", "pezy", "iluvatar", "moore", "nudt", "habana", "tesla", "hgx",
)
# Product lines before a code, and words about the board behind one.
LINE_WORDS = ("tesla", "radeon", "instinct", "hgx", "geforce", "quadro", "ascend", "habana")
BOARD_WORD = r"(?i)^(PCIe|PCle|SXM\d*|NVL\d*|NVLink|DGXS|OAM|FHHL|mezzanine|OEM|\d+\s?W|(\d+\s?)?(GB|GiB))$"
LEAST_CODE, LEAST_NAME = 2, 6
GATE = "gpu"


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def model_name(name: Column) -> Column:
    """The name without brackets and without what says only which board it is: memory, form, power.

    The first word always stays; the number of '80 GB' goes with its unit, other numbers stay."""
    joined = F.regexp_replace(F.regexp_replace(name, r"\s*\([^)]*\)", ""), r"(?i)(?<=\s)(\d+)\s+(GB|GiB|W)(?=\s|$)", "$1$2")
    # What is kept ends at the last word that is not about the board.
    words = _words(joined)
    kept = F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0))), lambda i: (i == 0) | ~F.coalesce(F.get(words, i).rlike(BOARD_WORD), F.lit(True)))
    return F.array_join(F.slice(words, 1, F.array_max(kept) + 1), " ")


def bracketed_names(name: Column) -> Column:
    """What brackets hold, where it has two letters and two digits or more: a second product name."""
    inner = F.transform(F.regexp_extract_all(name, F.lit(r"\(([^)]*)\)"), F.lit(1)), collapse)
    return F.filter(inner, lambda x: x.rlike(r"^[\w\s-]+$") & (F.length(F.regexp_replace(x, r"\D", "")) >= 2) & (F.length(F.regexp_replace(x, r"[^A-Za-z]", "")) >= 2))


def coverage_forms(name: Column) -> Column:
    """Spellings under which a lexicon may know the device: as written, without board words, and without
    the small letters of a revision (K20c)."""
    plain = model_name(name)
    revision = F.regexp_replace(plain, r"(?<=(?:^|\s)[A-Z]{1,2}\d{2,4})[a-z]{1,2}$", "")
    return F.array_distinct(F.array(collapse(name), plain, revision))


def spellings(devices: DataFrame) -> DataFrame:
    """(id, place, form): the ways to write each device (id, name, vendor), in order of preference."""
    base = model_name(F.col("name"))
    words = devices.withColumn("w", _words(base)).withColumn("extra", bracketed_names(F.col("name")))
    led = (F.lower(F.get("w", F.lit(0))) == F.lower("vendor")) & (F.size("w") > 1)
    rest = F.when(led, F.slice("w", 2, F.size("w"))).otherwise(F.col("w"))
    tail = words.withColumn("led", F.coalesce(led, F.lit(False))).withColumn("rest", rest).withColumn("core", F.filter("rest", lambda x: ~F.lower(x).isin(*LINE_WORDS)))
    text = lambda c: F.array_join(c, " ")
    apart = lambda t: F.when(t.rlike(r"^[A-Za-z]{3,}\d+$"), F.regexp_replace(t, r"^([A-Za-z]{3,})(\d+)$", "$1 $2"))
    forms = F.array(
        text("w"), F.when(~F.col("led") & F.col("vendor").isNotNull(), F.concat_ws(" ", "vendor", text("w"))), text("rest"),
        F.when(F.size("core") < F.size("rest"), F.concat_ws(" ", "vendor", text("core"))), text("core"), apart(text("rest")), apart(text("core")),
    )
    listed = tail.select("id", F.posexplode(F.concat(forms, "extra")).alias("place", "form")).where("form <> ''")
    return listed.groupBy("id", "form").agg(F.min("place").alias("place"))


def make_aliases(devices: DataFrame, claimed: DataFrame | None = None) -> DataFrame:
    """(id, place, form, gate, case) of devices (id, name, vendor): an id is one row, a null name has none.

    ``claimed``: forms that a lexicon has already.  Of devices that share a bare code, the first by id has
    it; a full name (place 0) always stays."""
    rows = spellings(devices)
    bare = ~F.col("form").contains(" ") & (F.length("form") < LEAST_NAME) & (F.col("place") > 0)
    unfit = (F.length("form") < LEAST_CODE) | F.col("form").rlike(r"^\d+$") | F.upper("form").isin(*DENIED_CODES)
    names, codes = rows.where(~bare), rows.where(bare & ~unfit)
    if claimed is not None:
        codes = codes.join(claimed.select("form"), "form", "left_anti")
    full = rows.where("place = 0").select(F.col("form").alias("f2"), F.col("id").alias("id2"))
    codes = codes.join(full, (F.col("form") == F.col("f2")) & (F.col("id") != F.col("id2")), "left_anti")
    first = codes.withColumn("r", F.row_number().over(Window.partitionBy("form").orderBy("id"))).where("r = 1").select("id", "place", "form", F.lit(GATE).alias("gate"))
    out = names.select("id", "place", "form", F.lit(None).cast("string").alias("gate")).union(first)
    loose = F.col("form").contains(" ") & F.lower(F.split("form", " ")[0]).isin(*VENDOR_WORDS)
    return out.withColumn("case", F.when(loose, "insensitive").otherwise("auto"))


def colliding(new: DataFrame, taken: DataFrame) -> DataFrame:
    """Rows of ``new`` whose id is one of ``taken``, or either starts the other at a hyphen.

    Each id is spread over its own beginnings, so that both directions are equality joins."""
    begins = lambda c: F.transform(F.sequence(F.lit(1), F.size(F.split(c, "-"))), lambda n: F.array_join(F.slice(F.split(c, "-"), 1, n), "-"))
    longer = new.select("id", F.explode(begins(F.col("id"))).alias("b")).join(taken.select(F.col("id").alias("b")), "b", "left_semi").select("id")
    shorter = new.select("id").join(taken.select(F.explode(begins(F.col("id"))).alias("id")), "id", "left_semi")
    return new.join(longer.union(shorter).distinct(), "id", "left_semi")


def entry_id(name: Column, vendor: Column) -> Column:
    """Slug of the name with the vendor in front where it has none."""
    plain = slug(name)
    return F.when(F.coalesce(vendor, F.lit("unknown")) == "unknown", plain).when(plain.startswith(F.concat(vendor, F.lit("-"))), plain).otherwise(F.concat(vendor, F.lit("-"), plain))
