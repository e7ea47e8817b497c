"""Mapping and dimension discovery (OP-F10, F12, F13, F14, A10, A11)."""

from pyspark.sql import functions as F

from provisio.operators import mapping as m


def test_map_branch_pass_through_and_null(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "Branche string")
    got = [r[0] for r in df.select(m.map_branch(F.col("Branche"), {"a": "A"})).collect()]
    assert got == ["A", "b", None]


def test_default_mapping_flags(spark):
    df = spark.createDataFrame([(" automobile ",), ("Santé",), ("SANTE",), (None,)], "Branche string")
    got = {r.Branche_obs: (r.Branche, r.matched) for r in m.default_mapping(df).collect()}
    assert got == {" automobile ": ("AUTOMOBILE", True), "Santé": ("AUTOMOBILE", False), "SANTE": ("SANTE", True)}


def test_staleness_both_ways(spark):
    df = spark.createDataFrame([("A",), ("B",), (None,)], "Branche string")
    got = {(r.key, r.status) for r in m.mapping_staleness(df, {"A": "X", "C": "Y"}).collect()}
    assert got == {("B", "observed_not_mapped"), ("C", "mapped_not_observed")}
    assert m.mapping_staleness(df, {"A": "X", "B": "Y"}).count() == 0


def test_years_and_defaults(spark):
    df = spark.createDataFrame([("2024", None), (None, 5.0), ("2023", 1.0)], "Exercice string, PN_ACC double")
    assert [r[0] for r in m.distinct_exercices(df).collect()] == ["2023", "2024", "NR"]
    assert m.last_exercice(df).first()[0] == "NR"                  # 'NR' sorts after digits
    filled = m.fill_defaults(df).collect()
    assert [(r.Exercice, r.PN_ACC) for r in filled] == [("2024", 0.0), ("NR", 5.0), ("2023", 1.0)]
    b = spark.createDataFrame([("B",), ("A",), (None,), ("A",)], "Branche string")
    assert [r[0] for r in m.distinct_branches(b).collect()] == ["A", "B"]
