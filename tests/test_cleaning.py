"""Cleaning goldens: amounts, headers, years, formats, text (FIXTURES.md section 5)."""

import pytest
from pyspark.sql import functions as F

from provisio.functions import amounts, formatting, text

NB, NN = "\u00a0", "\u202f"
AMOUNTS = [
    ("1 234,5", 1234.5, 1234.5), (f"1{NB}234,5", 1234.5, 1234.5), (f"1{NN}234,5", 1234.5, 1234.5),
    ("1,234", 1.234, 1.234), ("1,234,567", 0.0, None), ("1.234,56", 0.0, None),
    ("-", 0.0, None), ("—", 0.0, None), ("--", 0.0, None), ("- ", 0.0, None), ("- - ", 0.0, None),
    ("N/A", 0.0, None), ("#N/A", 0.0, None), (".", 0.0, None), ("..", 0.0, None),
    ("-500", -500.0, -500.0), ("- 500", -500.0, -500.0), ("(500)", 0.0, None), ("abc", 0.0, None),
    ("", 0.0, None), (None, 0.0, None), ("1e3", 1000.0, 1000.0), ("1d", 0.0, None), ("1.0f", 0.0, None),
]


def test_amount_parsers(spark):
    df = spark.createDataFrame([(a,) for a, _, _ in AMOUNTS], "s string")
    got = df.select("s", amounts.claims_amount("s").alias("c"), amounts.production_amount("s").alias("p")).collect()
    for (s, claims, prod), r in zip(AMOUNTS, got):
        assert r["c"] == claims, repr(s)
        assert r["p"] == prod, repr(s)


@pytest.mark.parametrize("headers,expected", [
    (["BRANCHE", "GARANTIE", "REGLEMENT", "COUT_TOTAL"], ("BRANCHE", "REGLEMENT", "COUT_TOTAL")),
    (["Branche", "Total  Règlement", "Coût  Total"], ("Branche", "Total  Règlement", "Coût  Total")),
    (["branche", "Date de règlement", "Total règlement", "Cout total brut"], ("branche", "Date de règlement", "Cout total brut")),
])
def test_header_resolution(headers, expected):
    f = text.resolve_claims_columns(headers)
    assert (f["Branche"], f["Total_Reglement"], f["Cout_Total"]) == expected


@pytest.mark.parametrize("headers,missing", [
    (["Branche produit", "Reglement", "cout_total"], "BRANCHE"),
    (["branche", "reglement", "cout_total_brut"], "COUT_TOTAL"),
])
def test_header_errors(headers, missing):
    with pytest.raises(ValueError) as e:
        text.resolve_claims_columns(headers)
    assert f"Colonnes manquantes: {missing}" in str(e.value)
    assert "Colonnes disponibles" in str(e.value)


def test_strip_year_and_formats(spark):
    df = spark.createDataFrame([(f"{NB} AUTO\t", "2024.0", 1234567.5, 0.72, 0.0)], "b string, y string, a double, r double, z double")
    r = df.select(text.clean_branch("b").alias("b"), text.clean_year("y").alias("y"),
                  formatting.fmt_amount("a").alias("fa"), formatting.fmt_report("a").alias("ra"),
                  formatting.fmt_report("r").alias("rr"), formatting.fmt_report("z").alias("rz"),
                  formatting.fmt_report(F.lit(None).cast("double")).alias("rn"),
                  formatting.fmt_percent("r").alias("p")).first()
    assert (r.b, r.y) == ("AUTO", "2024")
    assert r.fa == "1 234 567.50" and r.ra == "1 234 567.50"
    assert (r.rr, r.rz, r.rn, r.p) == ("0,7200", "0,00", "", "72.00%")


def test_format_half_even(spark):
    r = spark.createDataFrame([(0.125,)], "x double").select(formatting.fmt_amount("x").alias("f")).first()
    assert r.f == "0.12"


def test_sanitize_text(spark):
    r = spark.createDataFrame([("é≥→—😀",)], "t string").select(text.sanitize_text("t").alias("t")).first()
    assert r.t == "e>=->-?"


def test_parse_failure_flag(spark):
    df = spark.createDataFrame([("1,234,567",), ("-",), ("",), (None,), ("12,5",), ("abc",), ("N/A",)], "s string")
    got = [r[0] for r in df.select(amounts.amount_parse_failed("s")).collect()]
    assert got == [True, False, False, False, False, True, False]


def test_null_branch_drop(spark):
    from provisio.operators import premium
    cells = spark.createDataFrame([(None, "2024", 10.0, 4.0), ("A", "2024", 5.0, 1.0)],
                                  "Branche string, Exercice string, PE double, PREC double")
    r = premium.null_branch_drop(cells).first()
    assert (r.PE_dropped, r.PREC_dropped, r.PA_dropped) == (10.0, 4.0, 6.0)
