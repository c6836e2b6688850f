"""Registered queries beside their SQL at the smallest scale (the full set runs in tools/check_oracles.py)."""

import os

import pytest

import __spark_entry__ as entry
from check_oracles import TABLES, compare

SF = "/root/testdata/sf0.001"
SOME = [
    "flagship", "s1_read_csv", "s3_scan_symbol", "s7_upsert", "s8_delete_symbol", "s10_import_jobs", "p6_short_series",
    "j5_asof_join", "j6_bounded_range_join", "a4_exact_quantiles", "a9_large_gaps", "a12_classification_metrics", "w4_macd",
    "w15_split_date", "w18_expanding_folds", "k2_tail", "v9_outlier_counts", "v11_verdicts", "m2_standard_scaler", "m19_ensemble",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not mounted")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_catalogue_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 120


def test_catalogue_without_the_optional_part(monkeypatch):
    import importlib
    import sys

    for name in [m for m in sys.modules if m.startswith("barline.llm")] + ["corpus_pipeline"]:
        monkeypatch.setitem(sys.modules, name, None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    bare = importlib.util.module_from_spec(importlib.util.find_spec("__spark_entry__"))
    bare.__spec__.loader.exec_module(bare)
    assert len(bare.queries()) > 120 and not any(k.startswith("op") or k == "pipeline" for k in bare.queries())
    assert set(bare.oracle_sql()) <= set(bare.queries())


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF).toPandas()
    assert compare(got, duck.execute(entry.oracle_sql()[name]).df()) == "ok"


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_both_split_rules_read_one_set_of_bars(spark, monkeypatch):
    from barline.plans import queries

    asked, bars = [], queries.bars_supp
    monkeypatch.setattr(queries, "bars_supp", lambda *a: asked.append(1) or bars(*a))
    queries.m23_split_rule(spark, SF)
    assert len(asked) == 1
