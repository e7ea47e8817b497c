"""Brute force: random policies, plain-Python formulas per row, compared with
the Spark row-level view and the fused per-cell aggregation."""

from datetime import date, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from provisio.operators import premium
from provisio.operators.mapping import fill_defaults

EVAL = date(2024, 6, 30)
RATE = 0.8
LR = 0.72

day = st.one_of(st.none(), st.integers(min_value=-800, max_value=800).map(lambda k: EVAL + timedelta(days=k)))
policy = st.tuples(st.sampled_from(["A", "B"]), st.sampled_from(["2023", "2024"]),
                   st.one_of(st.none(), st.floats(min_value=-1e5, max_value=1e6, allow_nan=False)), day, day)


def expected_row(pn, eff, ech):
    pe = pn if pn is not None else 0.0
    total = (ech - eff).days if eff and ech else None
    if ech is not None and EVAL > ech:
        rest = 0
    elif eff is not None and eff > EVAL:
        rest = (ech - eff).days if ech else None
    else:
        rest = (ech - EVAL).days if ech else None
    if total == 0:
        prec = 0.0
    elif total is None or rest is None:
        prec = 0.0
    else:
        prec = pe * (rest / total) * RATE
    d = float(total) if total is not None else None
    t_raw = float((EVAL - eff).days) if eff else None
    inner = [x for x in (d, t_raw) if x is not None]
    t = max([0.0] + ([min(inner)] if inner else []))
    m = t / d if (d is not None and d > 0) else 0.0
    lf = 0.05 if (ech is not None and EVAL >= ech) else 0.95 - 0.90 * m
    ibnr = pe * m * LR * lf
    return prec, m, lf, ibnr


@settings(max_examples=15, deadline=None)
@given(st.lists(policy, min_size=1, max_size=40))
def test_prec_and_ibnr_bruteforce(spark_session, rows):
    spark = spark_session
    data = [(f"P{i}", b, y, pn, eff, ech) for i, (b, y, pn, eff, ech) in enumerate(rows)]
    df = fill_defaults(spark.createDataFrame(
        data, "Police string, Branche string, Exercice string, PN_ACC double, Effet date, Echeance date"))
    taux = spark.createDataFrame([("A", RATE), ("B", RATE)], "Branche string, Taux_PREC double")
    lines = {r.Police: r.PREC for r in premium.prec_lines(df, taux, EVAL).collect()}
    want = {}
    for i, (b, y, pn, eff, ech) in enumerate(rows):
        prec, m, lf, ibnr = expected_row(pn, eff, ech)
        assert lines[f"P{i}"] == pytest.approx(prec, rel=1e-9, abs=1e-6)
        w = want.setdefault((b, y), [0.0, 0.0, 0])
        w[0] += prec
        w[1] += ibnr
        w[2] += 1
    cells = premium.prec_cells(premium.policy_cells(df, EVAL, LR), taux).collect()
    ib = {(r.Branche, r.Exercice): (r.IBNR, r.Nb) for r in premium.policy_cells(df, EVAL, LR).collect()}
    for r in cells:
        w = want[(r.Branche, r.Exercice)]
        assert r.PREC == pytest.approx(w[0], rel=1e-9, abs=1e-6)
        assert ib[(r.Branche, r.Exercice)][0] == pytest.approx(w[1], rel=1e-9, abs=1e-6)
        assert ib[(r.Branche, r.Exercice)][1] == w[2]
