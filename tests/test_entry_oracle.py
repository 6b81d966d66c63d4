"""Driver contract and the DuckDB oracle at sf0.001 (every query with an oracle)."""

import math

import duckdb
import pytest

import __spark_entry__ as E

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _norm(v):
    if v is None:
        return "null"
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{round(v, 6):.6f}"
    return str(v)


def _rows(columns, rows):
    """Without pandas, which turns whole numbers next to nulls into floats."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck(sf_small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    return con


def test_entry_runs(spark):
    rows = E.entry(spark).collect()
    assert len(rows) == 1 and rows[0]["n_users"] == 150 and abs(rows[0]["mrr"] - 0.187251) < 1e-6


def test_oracle_keys_subset_of_queries():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_equals_oracle(spark, duck, sf_small, name):
    s = E.queries()[name](spark, sf_small)
    d = duck.execute(E.oracle_sql()[name])
    assert _rows(s.columns, s.collect()) == _rows([c[0] for c in d.description], d.fetchall())
