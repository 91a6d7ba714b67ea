from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quern.operators import matching
from quern.operators.lexicon import Alias, Entity, Lexicon, load_lexicon, load_taxonomy

LEXICON = Lexicon(
    "0.1",
    {k: Entity(k, k.upper(), "maker", kind, release="2017-06") for k, kind in (("ax100", "model"), ("ax", "model"), ("volt", "architecture"), ("card", "generic"), ("k9", "model"))},
    (Alias("ax100", "AX 100"), Alias("ax", "AX"), Alias("volt", "Volt", "hardware"), Alias("card", "graphics card"), Alias("k9", "K9", "hardware")),
    {"hardware": ("memory", "training")},
)


def found(text):
    return [(m[0], m[2]) for m in matching.Matcher(LEXICON).find(text)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("two AX-100s here", [("ax100", "AX-100s")]),
        ("an AX100 and an AX", [("ax100", "AX100"), ("ax", "AX")]),
        ("ax 100 in small letters", []),
        ("Graphics  Cards", [("card", "Graphics  Cards")]),
        ("MAX 100", []),
        ("AX_100", []),
        ("", []),
    ],
)
def test_find(text, want):
    assert found(text) == want


def paragraphs(spark, *texts):
    rows = [("p", k, t, None) for k, t in enumerate(texts)]
    return spark.createDataFrame([("p", sum(map(len, texts)))], "paper_id string, body_chars int"), spark.createDataFrame(rows, "paper_id string, idx int, text string, section string")


def scan(spark, *texts):
    inventory, candidates = matching.scan_papers(*paragraphs(spark, *texts), LEXICON)
    return inventory.first(), candidates.orderBy("para_idx").collect()


def test_gate_reads_neighbours(spark):
    inv, found = scan(spark, "nothing of note is said here", "the Volt was fast", "training took long")
    assert [r["para_idx"] for r in found] == [1]
    assert not found[0]["gate_rescued"]
    inv, found = scan(spark, "nothing", "the Volt was fast", "nothing", "training took long")
    assert found == [] and not inv["is_candidate"]


def test_rescue_by_an_ungated_model(spark):
    inv, found = scan(spark, "the Volt was fast", "nothing", "nothing", "an AX 100 was used")
    assert [(r["para_idx"], r["gate_rescued"], r["gated_only"]) for r in found] == [(0, True, True), (3, False, False)]


def test_caps(spark):
    inv, found = scan(spark, *["a graphics card"] * 9)
    assert inv["n_candidate_passages"] == 5 and inv["passages_truncated"]
    inv, found = scan(spark, *["an AX 100"] * 25)
    assert inv["n_candidate_passages"] == 20 and inv["passages_truncated"]


def test_passage_holds_the_match(spark):
    long = "a" * 4000 + " AX 100 " + "b" * 4000
    inv, found = scan(spark, "before", long, "after")
    row = found[0]
    assert len(row["passage_text"]) <= 2502
    assert row["passage_text"][row["match_starts"][0] : row["match_ends"][0]] == "AX 100"


def test_neighbours_fill_the_passage(spark):
    row = scan(spark, "x" * 3000, "an AX 100", "y" * 3000)[1][0]
    tail, core, head = row["passage_text"].split("\n")
    assert core == "an AX 100" and len(tail) == (2500 - 9) // 2 and len(tail) + len(core) + len(head) == 2500


def test_paper_without_paragraphs(spark):
    papers = spark.createDataFrame([("p", 0)], "paper_id string, body_chars int")
    empty = spark.createDataFrame([], "paper_id string, idx int, text string, section string")
    row = matching.scan_papers(papers, empty, LEXICON)[0].first()
    assert (row["n_paragraphs"], row["is_candidate"], row["has_body"]) == (0, False, False)


@pytest.mark.parametrize(("name", "want"), [("AX 100", "ax100"), ("AX (100)", "ax100"), ("Volt", None), ("Volt with training", "volt"), ("none", None), ("telescope AX", None), (None, None), ("graphics card AX", "ax")])
def test_canonical(spark, name, want):
    row = matching.canonicalise(spark.createDataFrame([(1, name)], "k int, name string"), "name", LEXICON).first()
    assert row["canonical_model"] == want


@pytest.mark.parametrize(("name", "want"), [("", "empty"), ("N/A", "llm-rejected-non-hardware"), ("Ampere", "architecture-only"), ("g4dn.xlarge", "cloud-instance"), ("Xeon Gold", "cpu"), ("what", "unknown")])
def test_buckets(spark, name, want):
    assert spark.createDataFrame([(name,)], "x string").select(matching.unresolved_bucket(F.col("x")).alias("y")).first()["y"] == want


def test_precision_flags(spark):
    rows = [("p", "we use FP16 and mixed-precision"), ("p", None), ("q", "quantized to int8"), ("q", "fp160")]
    got = {r["k"]: r for r in matching.pattern_flags(spark.createDataFrame(rows, "k string, t string"), "k", "t").collect()}
    assert got["p"]["prec_fp16"] and got["p"]["prec_mixed_precision"] and not got["p"]["prec_fp32"]
    assert got["p"]["n_passages_scanned"] == 2 and got["p"]["prec_surfaces"] == ["fp16", "mixed-precision"]
    assert got["q"]["prec_int8"] and got["q"]["prec_quantization"] and not got["q"]["prec_fp16"]


def test_lexicon_files(tmp_path):
    gen = tmp_path / "gen.yaml"
    gen.write_text("models:\n- {id: a, display: A, manufacturer: M, aliases: [Alpha 1]}\n- {id: b, display: B, manufacturer: M, release: 2019, aliases: [{pattern: Beta, gate: g}]}\n")
    hand = tmp_path / "hand.yaml"
    hand.write_text("version: 0.2\ncontext_terms: {g: [gpu]}\nmodels:\n- {id: a, display: AA, manufacturer: M, aliases: [Alpha]}\n")
    lexicon = load_lexicon(hand, [gen])
    assert lexicon.entities["a"].display == "AA" and lexicon.entities["b"].release == "2019"
    with pytest.raises(ValueError, match="two generated"):
        load_lexicon(hand, [gen, gen])
    with pytest.raises(ValueError, match="unknown gate"):
        Lexicon("1", {"a": Entity("a", "A", "M")}, (Alias("a", "Alpha", "nope"),))
    with pytest.raises(ValueError, match="twice"):
        Lexicon("1", {"a": Entity("a", "A", "M")}, (Alias("a", "Alpha"), Alias("a", "Alpha")))
    tax = tmp_path / "tax.yaml"
    tax.write_text("groups: {Physics: [hep-th, quant-ph]}\nlegacy: {acc-phys: hep-th}\n")
    assert load_taxonomy(tax) == {"hep-th": "Physics", "quant-ph": "Physics", "acc-phys": "Physics"}


def test_long_paragraphs_are_cut_around_their_matches(spark):
    """The passage of a long paragraph, against its definition in plain Python."""
    import random

    rng = random.Random(5)
    for _ in range(6):
        word = lambda n: " ".join("abcdefg"[: rng.randint(1, 7)] for _ in range(n))
        texts = [word(rng.randint(20, 60)), f"{word(rng.randint(1, 700))} AX 100 {word(rng.randint(1, 90))} K9 and training {word(rng.randint(1, 700))}", word(80)]
        (before, text, after), (start, end) = texts, (texts[1].index("AX 100"), texts[1].index("K9") + 2)
        _, found = scan(spark, *texts)
        first = max(0, min((start + end) // 2 - 1250, len(text) - 2500)) if len(text) > 2500 else 0
        core = text[first : first + 2500]
        room = 2500 - len(core)
        tail = before[-(room // 2) :] if room > 40 else ""
        head = after[: room - len(tail)] if room > 40 else ""
        assert found[0]["passage_text"] == (tail + "\n" if tail else "") + core + ("\n" + head if head else "")
        for surface, a, b in zip(found[0]["matched_surfaces"], found[0]["match_starts"], found[0]["match_ends"], strict=True):
            assert found[0]["passage_text"][a:b] == surface


def test_words_of_all_scripts_end_at_their_borders(spark):
    assert found("éAX 100") == [] and found("AX 100é") == [("ax", "AX")] and found("« AX 100 »") == [("ax100", "AX 100")] and found("日AX 100") == []
    inv, got = scan(spark, "naïve AX 100, élan; ÀAX 100 and AX 100ß", "x" * 40, "y" * 40)
    assert [len(r["matched_models"]) for r in got] == [2]
