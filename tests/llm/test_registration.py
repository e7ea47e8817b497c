"""Every numbered operator has its query, and SQL where there is some matches on a small table."""

import collections
import re

import duckdb
import pytest

import __spark_entry__ as entry
from provisio.llm import catalog

SF = "/root/testdata/sf0.001"


def test_one_query_per_operator():
    numbers = collections.Counter(int(m[1]) for q in entry.queries() if (m := re.match(r"op(\d+)_", q)))
    assert numbers == {n: 1 for n in range(1, 14)} and "pipeline" in entry.queries()
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_sql_gives_the_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    con.sql(catalog.ORACLES[name]).create_view("oracle")
    got = catalog.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM oracle").fetchall()
    assert collections.Counter(tuple(r) for r in got.select(cols).collect()) == collections.Counter(want)


def test_native_fingerprints_run_no_python(spark):
    plan = catalog.QUERIES["op6_iblt"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|ExistingRDD", plan)
