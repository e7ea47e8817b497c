"""Property tests (hypothesis): parser and matrix invariants on generated inputs."""

from hypothesis import given, settings
from hypothesis import strategies as st

from provisio.functions import amounts
from provisio.operators.recap import recap_matrix

amount = st.decimals(min_value=-10**9, max_value=10**9, places=2, allow_nan=False, allow_infinity=False)


@settings(max_examples=25, deadline=None)
@given(st.lists(amount, min_size=1, max_size=20))
def test_french_amount_round_trip(spark_session, values):
    nb = "\u00a0"   # French thousands separator
    def fr(d):
        s = f"{abs(d):,.2f}".replace(",", nb).replace(".", ",")
        return ("-" if d < 0 else "") + s
    df = spark_session.createDataFrame([(fr(v),) for v in values], "s string")
    got = [r[0] for r in df.select(amounts.claims_amount("s")).collect()]
    assert got == [float(v) for v in values]
    got_p = [r[0] for r in df.select(amounts.production_amount("s")).collect()]
    assert got_p == [float(v) for v in values]


cells_strategy = st.lists(st.tuples(st.sampled_from(["A", "B", "C", None]), st.sampled_from(["2021", "2022", "2023"]),
                                    st.integers(min_value=-1000, max_value=1000)), min_size=1, max_size=15,
                          unique_by=lambda t: (t[0], t[1]))


@settings(max_examples=20, deadline=None)
@given(cells_strategy)
def test_matrix_margins(spark_session, cells):
    df = spark_session.createDataFrame([(b, y, float(v)) for b, y, v in cells], "Branche string, Exercice string, v double")
    years = ["2021", "2022", "2023"]
    rows = recap_matrix(df, "v", years).collect()
    body, total = rows[:-1], rows[-1]
    assert total["Branche"] == "TOTAL"
    for y in years + ["Total"]:
        assert total[y] == sum(r[y] for r in body)
    for r in body:
        assert r["Total"] == sum(r[y] for y in years)
    assert sum(r["Total"] for r in body) == sum(v for _, _, v in cells)
