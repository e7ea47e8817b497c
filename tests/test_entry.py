"""Driver contract of __spark_entry__."""

import duckdb
import pytest

import __spark_entry__ as E
from provisio.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle_can_be_a_view(tables, name):
    tables.sql(catalog.ORACLES[name]).create_view(f"oracle_{name}")
    names = [c[0].lower() for c in tables.execute(f"DESCRIBE oracle_{name}").fetchall()]
    assert len(names) == len(set(names))


def test_contract_keys():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert all(callable(f) for f in q.values())
    core = set(catalog.QUERIES)
    assert core <= set(q) and core <= set(o)
    assert all(isinstance(s, str) and s.strip() for s in o.values())


def test_entry_runs_with_stable_schema(spark):
    a, b = E.entry(spark), E.entry(spark)
    assert a.schema == b.schema
    rows = a.collect()
    assert rows and rows[-1]["Branche"] == "TOTAL"
    assert a.columns[0] == "Branche" and a.columns[-1] == "Total"
