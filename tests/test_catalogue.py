"""Every query of the catalogue against its SQL twin, on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from quern.plans import catalogue, standins

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def rows(frame, columns):
    def plain(v):
        if v is None or (pd.api.types.is_scalar(v) and pd.isna(v)):
            return None
        if hasattr(v, "item"):
            v = v.item()
        return round(v, 6) if isinstance(v, float) else v

    def number(v):
        return float(v) if isinstance(v, int | float) and not isinstance(v, bool) else v

    return sorted((tuple(number(plain(v)) for v in r) for r in frame[columns].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, sql, name):
    got = catalogue.queries()[name](spark, str(DATA)).toPandas()
    text = catalogue.oracles().get(name)
    if text is None:
        assert len(got) > 0
        return
    want = sql.execute(text).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["lang", "n", "share"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["match_flags", "paper_level_rescue"])
def test_flags_of_long_paragraphs(spark, tmp_path, name):
    """Matches that the passage of a long paragraph has no room for count in its flags, as in SQL."""
    far = "x" * 4000
    texts = [f"the and {far} and {far} and", f"the and {far} die der {far} der", f"the and is said in this line of text\nder {far} and {far} der"]
    spark.createDataFrame([(k, t, "en", "web", len(t)) for k, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got, want = catalogue.queries()[name](spark, str(tmp_path)).toPandas(), con.execute(catalogue.oracles()[name]).df()
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))


DEALT = ("half_life", "observation_table", "rank_compare", "adoption_after_release", "hhi_entropy", "topic_composition", "paper_flags")


@pytest.mark.parametrize("name", DEALT)
def test_what_meets_in_a_task_does_not_grow(spark, sql, monkeypatch, name):
    """Rows that meet by a key are dealt to as many tasks as the files take, with the results of SQL."""
    monkeypatch.setattr(standins, "BYTES_PER_TASK", (DATA / "lineitem.parquet").stat().st_size // 9)
    made = catalogue.queries()[name](spark, str(DATA))
    assert "hashpartitioning(paper" in (plan := made._jdf.queryExecution().executedPlan().toString()) and ", 10), REPARTITION_BY_NUM" in plan
    want = sql.execute(catalogue.oracles()[name]).df()
    assert rows(made.toPandas(), sorted(made.columns)) == rows(want, sorted(made.columns))
