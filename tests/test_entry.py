"""The registered queries against their SQL in DuckDB."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same(spark, sf, name, f, sql):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    a, b = f(spark, sf).toPandas(), c.execute(sql).df()
    assert sorted(a.columns) == sorted(b.columns)
    rows = lambda d: sorted((tuple(None if pd.isna(v) else v for v in r) for r in d[sorted(a.columns)].astype(object).itertuples(index=False, name=None)), key=repr)
    assert rows(a) == rows(b)


@pytest.mark.parametrize("name", sorted(entry._SQL))
def test_query_matches_sql(spark, sf, name):
    same(spark, sf, name, entry._Q[name], entry._SQL[name])


def test_other_queries_live_without_a_module_that_fails(monkeypatch):
    def missing(name):
        raise ImportError(f"{name} needs what isn't here")

    monkeypatch.setattr(entry.importlib, "import_module", missing)
    assert entry.queries().keys() == entry._Q.keys() and entry.oracle_sql() == entry._SQL


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() == 25
    assert entry.oracle_sql().keys() <= entry.queries().keys()
    assert set(entry._SQL) == set(entry._Q)
