import os

import duckdb
import pytest

import __spark_entry__ as E
from fareshift.plans import catalog
from fareshift.plans.roles import TABLES

SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["service_day", "local_route", "ridership"]
    assert df.count() >= 0


def test_every_query_has_an_oracle():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
    assert set(catalog.QUERIES) <= set(E.queries()) and set(E.oracle_sql()) <= set(E.queries())


_DUCK_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
               "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN"}


def _norm(v):
    return v  # exact: the driver hashes values


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data absent")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = duck.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in cur.description]
    assert sorted(ocols) == cols
    otypes = {d[0]: str(d[1]) for d in cur.description}
    for c, t in df.dtypes:
        assert _DUCK_TYPES.get(t, t) == otypes[c], (c, t, otypes[c])
    idx = [ocols.index(c) for c in cols]
    exp = sorted((tuple(_norm(r[i]) for i in idx) for r in cur.fetchall()), key=repr)
    assert got == exp


def test_run_period_writes_summaries(spark, tmp_path):
    from fareshift.plans import roles
    from fareshift.plans.period import run_period
    td, pos, rules = roles.td(spark, SF), roles.positions(spark, SF), roles.rules(spark)
    out = run_period(td, pos, rules, str(tmp_path), start="2024-01-01", end="2024-01-30",
                     north=60.0, south=20.0, fleet=None, label="jan")
    assert sorted(out) == ["by_day", "by_type_long", "by_type_wide", "questionable"]
    back = spark.read.csv(str(tmp_path / "jan_by_type_long"), header=True)
    assert back.count() == out["by_type_long"].count() > 0


def test_report_queries_are_in_order(spark):
    """The comparison above sorts; these rows must come as they are."""
    got = [(r.service_type, r.local_route) for r in E.queries()["report_ordered"](spark, SF).collect()]
    assert got == sorted(sorted(got, key=lambda x: x[1]), key=lambda x: x[0], reverse=True)
    assert [r.route for r in E.queries()["reconcile_sorted"](spark, SF).collect()] == ["8", "25", "90", "901", "902"]


def test_whole_table_counts_share_the_groups_aggregate(spark):
    df = E.queries()["bad_gps_by_month_route"](spark, SF)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan") == 2 and "SinglePartition" not in plan


def test_ridership_queries_need_no_training_data_library(monkeypatch):
    import sys
    for m in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("fareshift.llm")]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setitem(sys.modules, "tiktoken", None)
    monkeypatch.setitem(sys.modules, "tokenizers", None)
    monkeypatch.setitem(sys.modules, "fareshift.llm", None)
    assert set(E.queries()) == set(catalog.QUERIES) == set(E.oracle_sql())
