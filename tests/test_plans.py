"""Plan shape: broadcasts where bounded, no Python UDFs, pushed filters, one
shuffle per scan; invariants that must hold whatever the partitioning."""

import re

import pytest
from pyspark.sql import functions as F

from provisio.operators import premium
from provisio.operators.mapping import map_policies
from provisio.plans import catalog
from provisio.sources import fixtures as fx

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rate_join_is_broadcast(spark):
    st = catalog.policy_stage(spark, SF)
    lines = premium.prec_lines(st.mapped, st.taux, st.params.date_eval)
    assert "ResolvedHint" not in lines._jdf.queryExecution().analyzed().toString()
    lines.collect()
    p = plan(lines)                                            # the plan that ran: sizes decided
    assert "BroadcastHashJoin" in p and "Taux_PREC" in p


@pytest.mark.parametrize("name", ["pe_recap_matrix", "claims_agg", "psap_matrix", "sanitize_text", "claims_amount_parse"])
def test_no_python_udf(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    text = df._jdf.queryExecution().optimizedPlan().toString() + plan(df)
    assert "PythonUDF" not in text and "BatchEvalPython" not in text and "ArrowEvalPython" not in text


def test_policy_scan_single_aggregation(spark):
    """Scan -> map -> one partial/final aggregate; columns pruned at the scan."""
    raw = fx.policies_raw(spark, SF)
    p = fx.fixture_params()
    cells = premium.policy_cells(map_policies(raw, p.mapping), p.date_eval)
    sp = cells._jdf.queryExecution().sparkPlan().toString()
    assert sp.count("HashAggregate") == 2                      # partial + final
    assert "l_comment" not in sp and "l_tax" not in sp         # pruned columns
    assert "element_at" in sp                                  # mapping is a map literal, no join


def test_claims_read_every_line_item(spark):
    assert fx.claims_raw(spark, SF).count() == fx.table(spark, SF, "lineitem").count()


def test_invariants(spark):
    st = catalog.policy_stage(spark, SF)
    cells = st.prec.join(st.pa, ["Branche", "Exercice"])
    bad = cells.filter(F.abs(F.col("PE") - F.col("PREC") - F.col("PA")) > 1e-6).count()
    assert bad == 0                                            # PA + PREC = PE per cell
    pe_before = fx.policies_raw(spark, SF).agg(F.sum(F.coalesce("PN_ACC", F.lit(0.0)))).first()[0]
    pe_after = st.pe.agg(F.sum("PE")).first()[0]
    assert pe_after == pytest.approx(pe_before, rel=1e-12)      # mapping keeps the total
    split = st.pa_split.filter(F.col("Branche").isin("AUTO RC", "AUTO AR")).groupBy("Exercice").agg(F.sum("PA").alias("s"))
    auto = st.pa.filter(F.col("Branche") == "AUTOMOBILE").select("Exercice", F.col("PA").alias("a"))
    shares = {y for y, _, _ in st.params.platform_shares}
    for r in split.join(auto, "Exercice").collect():           # RC + AR = AUTOMOBILE when shares sum to 1
        if r.Exercice in shares:
            assert r.s == pytest.approx(r.a, rel=1e-9)
        else:
            assert r.s == 0.0
    m = catalog.QUERIES["pe_recap_matrix"](spark, SF).collect()
    body, total = m[:-1], m[-1]
    assert total["Branche"] == "TOTAL"
    assert total["Total"] == pytest.approx(sum(r["Total"] for r in body), abs=0.05)


def test_partition_count_independence(spark):
    raw = fx.policies_raw(spark, SF)
    p = fx.fixture_params()
    a = premium.policy_cells(map_policies(raw, p.mapping), p.date_eval)
    b = premium.policy_cells(map_policies(raw.repartition(3), p.mapping), p.date_eval)
    ra = {(r.Branche, r.Exercice): (round(r.PE, 6), round(r.PREC_base, 6), r.Nb) for r in a.collect()}
    rb = {(r.Branche, r.Exercice): (round(r.PE, 6), round(r.PREC_base, 6), r.Nb) for r in b.collect()}
    assert ra == rb


def test_last_year_filter_prunes_partitions(spark):
    import tempfile

    from provisio.sources import production as prod
    path = tempfile.mkdtemp(prefix="provisio-landed-") + "/t"
    prod.write_production(fx.policies_raw(spark, SF), path)
    landed = prod.read_landed(spark, path)
    last = premium.last_year_filter(landed, "2001")
    sp = last._jdf.queryExecution().sparkPlan().toString()
    import re
    part = re.search(r"PartitionFilters: \[([^\]]*)\]", sp).group(1)
    assert "Exercice" in part and "2001" in part
    assert last.count() == fx.policies_raw(spark, SF).filter(F.col("Exercice") == "2001").count()


def test_last_year_is_found_while_the_query_runs(spark, tmp_path):
    from provisio.sources import production as prod
    path = f"{tmp_path}/t"
    prod.write_production(fx.policies_raw(spark, SF), path)
    last = prod.last_year_landed(prod.read_landed(spark, path)).select("Police", "Exercice")
    rows = last.collect()
    want = fx.policies_raw(spark, SF)
    year = want.agg(F.max("Exercice")).first()[0]
    assert {r.Exercice for r in rows} == {year} and len(rows) == want.filter(F.col("Exercice") == year).count()
    scan = last._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*Exercice#\d+ = (Reused)?Subquery", scan)      # a run-time partition filter


def test_row_groups_of_a_landed_table(spark, tmp_path, monkeypatch):
    from provisio.sources import production as prod
    monkeypatch.setattr(prod, "PARQUET_ROW_GROUP_ROWS", 250)
    rows = fx.policies_raw(spark, SF)
    prod.write_production(rows, f"{tmp_path}/t")
    groups = prod.row_groups(spark, f"{tmp_path}/t").collect()
    assert max(r.rows for r in groups) <= 250 and sum(r.rows for r in groups) == rows.count()
    assert len(groups) > len({r.file for r in groups})


@pytest.mark.parametrize("ranges", [None, 1, 7])
def test_numbered_rows(spark, ranges):
    from provisio.operators.ordering import branch_order, numbered
    names = [None, "TOTAL", "B", "é", "A", "a", "", "Z"]
    df = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "Branche string, i int").repartition(3)
    got = [r.Branche for r in sorted(numbered(df, branch_order(), n_ranges=ranges).collect(), key=lambda r: r.row_no)]
    assert got == [None, "", "A", "B", "Z", "a", "é", "TOTAL"]
    assert sorted(r.row_no for r in numbered(spark.range(1000).repartition(4), [F.col("id").desc()], n_ranges=ranges).collect()) == list(range(1, 1001))
    assert numbered(df.limit(0), branch_order()).count() == 0


def test_exact_sums_of_any_partitioning(spark):
    from decimal import Decimal

    from provisio.operators.exact import exact_cells
    rows = [("A", "2024", x) for x in [0.1] * 1000 + [1e9, -1e9, 0.00005, None, float("inf"), float("nan")]]
    df = spark.createDataFrame(rows, "Branche string, Exercice string, v double")
    sums = {exact_cells(df.repartition(n), {"s": "v"}).first().s for n in (1, 2, 5)}
    assert sums == {Decimal("100.0001")}


@pytest.mark.parametrize("name, before", [("pe_recap_matrix", 1), ("prec_recap_matrix", 1), ("claims_sap_matrix", 1), ("report_cells", 2)])
def test_one_job_before_the_action(spark, name, before):
    """The cells are stored and their years gathered by one job (one per table of cells); nothing else runs until a result is asked for."""
    store = spark._jsparkSession.sharedState().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    n = store.executionsCount()
    catalog.QUERIES[name](spark, SF)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    assert store.executionsCount() - n == before


def test_a_run_with_exact_amounts_is_the_same_bit_for_bit(spark):
    from dataclasses import replace

    from provisio.plans.pipeline import ClaimsStage, PolicyStage
    p = replace(fx.fixture_params(), exact_amounts=True)
    raw, claims = fx.policies_raw(spark, SF), fx.claims_raw(spark, SF)
    cells = [sorted(map(tuple, PolicyStage(df, p).pe.collect())) for df in (raw, raw.repartition(7), raw.repartitionByRange(3, "PN_ACC"))]
    assert cells[0] == cells[1] == cells[2] and len(cells[0]) > 10
    sums = [sorted(map(tuple, ClaimsStage(df, p).cells.collect())) for df in (claims, claims.repartition(7), claims.coalesce(1))]
    assert sums[0] == sums[1] == sums[2]
    plain = {(r.Branche, r.Exercice): r.SAP for r in ClaimsStage(claims, fx.fixture_params()).cells.collect()}
    assert all(plain[b, y] == pytest.approx(sap, abs=1e-4) for b, y, *_, sap in sums[0])
