"""Matrix, split, CU, PSAP semantics on small hand-made cells."""

import pytest

from provisio.operators import premium, reserves
from provisio.operators.recap import recap_matrix


def rows(df):
    return {r[0]: r.asDict() for r in df.collect()}


def test_recap_matrix_margins_and_order(spark):
    cells = spark.createDataFrame([("B", "2024", 2.0), ("A", "2023", 1.0), (None, "2024", 5.0)],
                                  "Branche string, Exercice string, v double")
    m = recap_matrix(cells, "v", ["2024", "2023"])
    assert m.columns == ["Branche", "2023", "2024", "Total"]
    out = m.collect()
    assert [r["Branche"] for r in out] == [None, "A", "B", "TOTAL"]       # nulls first, TOTAL last
    assert out[-1]["2023"] == 1.0 and out[-1]["2024"] == 7.0 and out[-1]["Total"] == 8.0
    assert out[1]["2024"] == 0.0                                         # missing cell -> 0


def test_split_coefficients(spark):
    pa = spark.createDataFrame([("AUTOMOBILE", "2023", 100.0), ("AUTOMOBILE", "2030", 50.0), ("SANTE", "2023", 7.0)],
                               "Branche string, Exercice string, PA double")
    plat = [("2023", 0.65, 0.35)]
    types = [("AUTO RC", 0.87, 0.82), ("AUTO AR", 0.13, 0.18)]
    out = {(r.Branche, r.Exercice): r.PA for r in premium.pa_split(pa, plat, types).collect()}
    assert out[("AUTO RC", "2023")] == pytest.approx(85.25)
    assert out[("AUTO AR", "2023")] == pytest.approx(14.75)
    assert out[("AUTO RC", "2030")] == 0.0            # year without shares: 0/0
    assert out[("SANTE", "2023")] == 7.0
    assert ("AUTOMOBILE", "2023") not in out
    # without both guarantee types the input is unchanged
    same = premium.pa_split(pa, plat, [("AUTO RC", 1.0, 1.0)])
    assert same.count() == 3


def test_psap_example(spark):
    """FIXTURES.md PSAP example."""
    cu = spark.createDataFrame([("AUTO RC", "2024", 80.0), ("AUTO AR", "2024", 20.0),
                                ("TRANSPORT", "2024", 10.0), ("TRANSPORT", "2025", 0.0)],
                               "Branche string, Exercice string, CU double")
    paid = spark.createDataFrame([("AUTOMOBILE", "2024", 130.0), ("TRANSPORT", "2025", 5.0),
                                  ("VOYAGE", "2024", 7.0), ("AUTOMOBILE", "2021", 9.0)],
                                 "Branche string, Exercice string, Total_Reglement double")
    years = ["2024", "2025"]
    over = reserves.assemble_overrides(spark, [("SANTE", "2024", 3.0)], None, years)
    m = rows(recap_matrix(reserves.psap_cells(cu, paid, over, years), "PSAP", years))
    assert set(m) == {"AUTOMOBILE", "SANTE", "TRANSPORT", "TOTAL"}
    assert (m["AUTOMOBILE"]["2024"], m["AUTOMOBILE"]["2025"], m["AUTOMOBILE"]["Total"]) == (-30.0, 0.0, -30.0)
    assert (m["SANTE"]["2024"], m["SANTE"]["2025"], m["SANTE"]["Total"]) == (3.0, 0.0, 3.0)
    assert (m["TRANSPORT"]["2024"], m["TRANSPORT"]["2025"], m["TRANSPORT"]["Total"]) == (10.0, -5.0, 5.0)
    assert (m["TOTAL"]["2024"], m["TOTAL"]["2025"], m["TOTAL"]["Total"]) == (-17.0, -5.0, -22.0)


def test_cu_and_aggregation(spark):
    pa = spark.createDataFrame([(" AUTO RC", "2024", 100.0), ("AUTO AR", "2024", 50.0), ("X", "2024", 10.0)],
                               "Branche string, Exercice string, PA double")
    cu = reserves.cu_cells(pa, {"AUTO RC ": 0.5, "AUTO AR": 0.2})
    got = {r.Branche: r.CU for r in cu.collect()}
    assert got == {"AUTO RC": 50.0, "AUTO AR": 10.0, "X": 0.0}
    agg = {r.Branche: r.CU for r in reserves.cu_aggregated(cu).collect()}
    assert agg == {"AUTOMOBILE": 60.0, "X": 0.0}


def test_an_existing_motor_branch_stays_its_own_row(spark):
    cu = spark.createDataFrame([("AUTO RC", "2024", 50.0), ("AUTO AR", "2024", 10.0), ("AUTOMOBILE", "2024", 7.0), ("X", "2024", 1.0)],
                               "Branche string, Exercice string, CU double")
    m = [(r.Branche, r["2024"]) for r in recap_matrix(reserves.cu_aggregated(cu), "CU", ["2024"], part="_merged").collect()]
    assert m == [("AUTOMOBILE", 7.0), ("AUTOMOBILE", 60.0), ("X", 1.0), ("TOTAL", 68.0)]
    # what was paid is taken from either row, as the matrix join does
    paid = spark.createDataFrame([("AUTOMOBILE", "2024", 5.0)], "Branche string, Exercice string, Total_Reglement double")
    p = recap_matrix(reserves.psap_cells(cu, paid, None, ["2024"]), "PSAP", ["2024"], part="_merged").collect()
    assert [(r.Branche, r["2024"]) for r in p] == [("AUTOMOBILE", 2.0), ("AUTOMOBILE", 55.0), ("X", 1.0), ("TOTAL", 58.0)]


def test_psap_corporels_gate(spark):
    sap = spark.createDataFrame([("DOMMAGES CORPORELS", "2024", 5.0)], "Branche string, Exercice string, SAP double")
    ib = spark.createDataFrame([("2023", 2.0)], "Exercice string, IBNR double")
    corp = {r.Exercice: r.PSAP for r in reserves.psap_corporels(sap, ib, ["2023", "2024"]).collect()}
    assert corp == {"2023": 2.0, "2024": 5.0}
    empty_ib = ib.filter("false")
    assert reserves.psap_corporels(sap, empty_ib, ["2023", "2024"]).count() == 0
