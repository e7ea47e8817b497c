"""Golden policy rows G1-G13 (date_eval 2024-06-30, rate 0.80, IBNR LR 0.72)."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from provisio.operators import premium
from provisio.operators.mapping import fill_defaults

EVAL = date(2024, 6, 30)
D = date.fromisoformat

# case, PN_ACC, Effet, Echeance, total, remaining, PREC, M, LF, Prime_Acquise, IBNR, anomaly
CASES = [
    ("G1", 1000.0, "2024-01-01", "2024-12-31", 365, 184, 403.287671, 0.495890, 0.503699, 495.890411, 179.841111, False),
    ("G2", 1000.0, "2023-01-01", "2023-12-31", 364, 0, 0.0, 1.0, 0.05, 1000.0, 36.0, False),
    ("G3", 1000.0, "2024-09-01", "2025-09-01", 365, 365, 800.0, 0.0, 0.95, 0.0, 0.0, False),
    ("G4", 1000.0, "2023-06-30", "2024-06-30", 366, 0, 0.0, 1.0, 0.05, 1000.0, 36.0, False),
    ("G5", 1000.0, "2024-06-30", "2025-06-30", 365, 365, 800.0, 0.0, 0.95, 0.0, 0.0, False),
    ("G6", 1000.0, "2024-05-01", "2024-05-01", 0, 0, 0.0, 0.0, 0.05, 0.0, 0.0, False),
    ("G7", 1000.0, "2024-03-01", "2024-02-01", -29, 0, 0.0, 0.0, 0.05, 0.0, 0.0, True),
    ("G8", 1000.0, "2024-12-01", "2024-11-01", -30, -30, 800.0, 0.0, 0.95, 0.0, 0.0, True),
    ("G9", 1000.0, "2024-09-01", "2024-03-01", -184, 0, 0.0, 0.0, 0.05, 0.0, 0.0, True),
    ("G10", 1000.0, "2024-01-01", None, None, None, 0.0, 0.0, 0.95, 0.0, 0.0, False),
    ("G11", 1000.0, None, "2024-12-31", None, 184, 0.0, 0.0, 0.95, 0.0, 0.0, False),
    ("G12", None, "2024-01-01", "2024-12-31", 365, 184, 0.0, 0.495890, 0.503699, 0.0, 0.0, False),
    ("G13", -500.0, "2024-01-01", "2024-12-31", 365, 184, -201.643836, 0.495890, 0.503699, -247.945205, -89.920555, False),
]


@pytest.fixture(scope="module")
def golden(spark):
    rows = [(c[0], "X", "2024", c[1], D(c[2]) if c[2] else None, D(c[3]) if c[3] else None) for c in CASES]
    df = spark.createDataFrame(rows, "Police string, Branche string, Exercice string, PN_ACC double, Effet date, Echeance date")
    return fill_defaults(df)


def test_prec_lines(spark, golden):
    taux = spark.createDataFrame([("X", 0.80)], "Branche string, Taux_PREC double")
    got = {r["Police"]: r for r in premium.prec_lines(golden, taux, EVAL).collect()}
    for c in CASES:
        r = got[c[0]]
        assert r["duree_totale"] == c[4], c[0]
        assert r["duree_restante"] == c[5], c[0]
        assert r["PREC"] == pytest.approx(c[6], abs=1e-6), c[0]


def test_ibnr_of_each_policy(spark, golden):
    """Each policy as a branch of its own, through the aggregate that the method runs."""
    cells = premium.policy_cells(golden.withColumn("Branche", F.col("Police")), EVAL, 0.72)
    got = {r["Branche"]: r for r in cells.collect()}
    for c in CASES:
        r = got[c[0]]
        assert (r["Prime_Acquise"] or 0.0) == pytest.approx(c[9], abs=1e-6), c[0]
        assert (r["IBNR"] or 0.0) == pytest.approx(c[10], abs=1e-6), c[0]
        assert r["Charge_Theorique"] == pytest.approx(0.72 * c[9], abs=1e-6), c[0]


def test_anomalies(spark, golden):
    got = {r["Police"] for r in premium.date_anomalies(golden).collect()}
    assert got == {c[0] for c in CASES if c[11]}


def test_cells_equal_row_level(spark, golden):
    """Fused per-cell PREC equals the sum of row-level PREC."""
    taux = spark.createDataFrame([("X", 0.80)], "Branche string, Taux_PREC double")
    cells = premium.policy_cells(golden, EVAL, 0.72)
    prec = premium.prec_cells(cells, taux).collect()[0]["PREC"]
    rows = sum(r["PREC"] for r in premium.prec_lines(golden, taux, EVAL).collect())
    assert prec == pytest.approx(rows, abs=1e-6)
    ib = cells.collect()[0]["IBNR"]
    assert ib == pytest.approx(sum(c[10] for c in CASES), abs=1e-5)


def test_rate_example(spark):
    cells = spark.createDataFrame([("A", "2024", 600.0), ("B", "2024", 400.0), ("A", "2023", 999.0)],
                                  "Branche string, Exercice string, PE double")
    t = {r["Branche"]: r for r in premium.taux_prec(cells, {"A": 0.70, "B": 0.60, "C": 0.90}, 100.0).collect()}
    assert set(t) == {"A", "B", "C"}
    assert t["A"]["FG_Reparti"] == pytest.approx(60.0) and t["A"]["Taux_PREC"] == pytest.approx(0.75)
    assert t["B"]["FG_Reparti"] == pytest.approx(40.0) and t["B"]["Taux_PREC"] == pytest.approx(0.72)
    assert t["C"]["PE_Total"] == 0.0 and t["C"]["Taux_PREC"] == pytest.approx(0.90)


def test_rate_total_includes_branches_without_ratio(spark):
    """total_pe covers every last-year branch, even when no ratio branch has premium."""
    cells = spark.createDataFrame([("X", "2024", 1000.0)], "Branche string, Exercice string, PE double")
    r = premium.taux_prec(cells, {"A": 0.70}, 100.0).first()
    assert (r.PE_Total, r.FG_Reparti, r.Taux_PREC) == (0.0, 0.0, 0.72)
