"""End-to-end run (OP-R12) and the report sink (OP-S5)."""

import os
import re
import tempfile

from pyspark.sql import functions as F

import pytest

from provisio.operators import reserves
from provisio.operators.recap import recap_matrix
from provisio.params import ReservingParams
from provisio.plans import catalog, pipeline
from provisio.plans.pipeline import ReservingPipeline
from provisio.plans.report import SECTIONS, report_cells, write_report
from provisio.sources import fixtures as fx
from provisio.sources import production as prod

SF = "/root/testdata/sf0.001"


def test_pipeline_run_matches_registered_queries(spark):
    run = ReservingPipeline(fx.policies_raw(spark, SF), fx.claims_raw(spark, SF), fx.fixture_params()).run()
    assert {"PE", "Taux PREC", "PREC", "PA", "PA split", "CU", "CU agrege", "SAP", "IBNR", "PSAP"} <= set(run)
    psap = catalog.rounded(run["PSAP"]).collect()
    ref = catalog.QUERIES["psap_matrix"](spark, SF).collect()
    assert [tuple(r) for r in psap] == [tuple(r) for r in ref]
    cu = run["CU"].select("Branche").collect()
    assert {"SANTE", "DOMMAGES CORPORELS"}.isdisjoint({r[0] for r in cu})     # hidden in the display


def test_report_is_written_in_order(spark):
    st = catalog.policy_stage(spark, SF)
    rep = report_cells({"PE": st.pe, "PA": st.pa}, comments={"PE": "Production émise — base ≥ 0"})
    out = tempfile.mkdtemp(prefix="provisio-report-")
    write_report(rep, f"{out}/report")
    back = spark.read.option("header", True).csv(f"{out}/report")
    assert back.count() == rep.count()
    names = sorted(f for f in os.listdir(f"{out}/report") if f.endswith(".csv"))
    keys = [(int(r["section_no"]), int(r["row_no"]), r["col_name"]) for f in names for r in spark.read.option("header", True).csv(f"{out}/report/{f}").collect()]
    assert keys == sorted(keys)
    comment = back.filter(F.col("col_name") == "comment").first()
    assert comment["value_text"] == "Production emise - base >= 0"


def test_sanitize_cells_and_derive_pn_acc(spark):
    import datetime
    df = spark.createDataFrame([(None, datetime.date(2024, 1, 2), 3.0, None, 100.0, 5.0)],
                               "t string, d date, x double, PN_ACC double, Prime_Nette double, Accessoires double")
    r = prod.sanitize_cells(df).first()
    assert (r.t, r.d, r.x) == ("", "2024-01-02", 3.0)
    assert prod.derive_pn_acc(df).first().PN_ACC == 105.0


def test_reserve_joins_need_no_hints(spark):
    """No hint in the plans, and the same result when nothing may be broadcast."""
    st, cl = catalog.both_stages(spark, SF)
    psap = catalog.rounded(catalog.recap_matrix(pipeline.psap(st, cl), "PSAP", st.years, part="_merged"))
    assert "ResolvedHint" not in psap._jdf.queryExecution().analyzed().toString()
    want = [tuple(r) for r in psap.collect()]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        again = catalog.rounded(catalog.recap_matrix(pipeline.psap(st, cl), "PSAP", st.years, part="_merged"))
        assert [tuple(r)[0] for r in again.collect()] == [r[0] for r in want]
        for a, b in zip(again.collect(), want):
            assert tuple(a)[1:] == pytest.approx(b[1:], abs=0.011)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", ["date_anomalies", "split_params", "loss_ratio_resolved", "pe_by_exercice_mapped", "format_numbers"])
def test_simple_queries_run_nothing_before_their_action(spark, name):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup(f"lazy-{name}", name)
    catalog.QUERIES[name](spark, SF)
    assert list(tracker.getJobIdsForGroup(f"lazy-{name}")) == []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_report_plan_reads_stored_cells(spark):
    """One scan of each cell table, one more for the rate table and one for the last year's total."""
    st, cl = catalog.both_stages(spark, SF)
    rep = pipeline.reserving_report(st, cl)
    plan = rep._jdf.queryExecution().sparkPlan().toString()
    assert "Scan ExistingRDD" not in plan.replace("Scan ExistingRDD[]", "") and "Join" not in plan.replace("BroadcastHashJoin", "", 1)
    assert plan.count("FileScan parquet") == 3
    rep.collect()
    ran = rep._jdf.queryExecution().executedPlan().toString()
    final = ran[ran.index("Final Plan"):ran.index("Initial Plan")]     # of the first subquery or the whole
    assert len(set(re.findall(r"ReusedSubquery Subquery subquery#\d+", ran))) == 1 and final.count("FileScan parquet") <= 4


def test_report_from_one_plan_is_the_report_of_the_frames(spark):
    st, cl = catalog.both_stages(spark, SF)
    frames = {"PE": st.pe, "Taux PREC": st.taux, "PREC": st.prec, "PA": st.pa, "PA split": st.pa_split, "CU": st.cu, "CU agrege": reserves.cu_aggregated(st.cu),
              "Sinistres nombre": cl.cells, "Sinistres cout": cl.cells, "Reglements": cl.cells, "SAP": cl.cells, "PSAP": pipeline.psap(st, cl)}
    key = lambda r: (r.section_no, r.row_no, str(r.Branche), r.col_name)
    one, many = (sorted(catalog.rounded(df.drop("value_text")).collect(), key=key) for df in (pipeline.reserving_report(st, cl), report_cells(frames)))
    assert [key(r) for r in one] == [key(r) for r in many] and {r.section_no for r in one} == set(range(1, 13))
    assert all(a.value_double == pytest.approx(b.value_double, abs=0.011) for a, b in zip(one, many))


@pytest.mark.parametrize("types, manual", [([("AUTO RC", 0.87, 0.82)], []), ([("AUTO RC", 0.87, 0.82), ("AUTO AR", 0.13, 0.18)], [("SANTE", "2024", 5.0)])])
def test_wide_cells_of_odd_branches(spark, types, manual):
    """Null, TOTAL, padded and motor branches, with and without split and manual rows: as the tables one by one."""
    import datetime
    day = datetime.date(2024, 1, 1)
    raw = [(f"p{i}", b, y, day, datetime.date(2025, 6, 1 + i), 100.0 + i) for i, (b, y) in enumerate(
        (b, y) for b in ("AUTOMOBILE", " AUTOMOBILE", "AUTO RC", "TOTAL", None, "DOMMAGES CORPORELS", "SANTE", "X ") for y in ("2023", "2024", None))]
    policies = spark.createDataFrame(raw, "Police string, Branche string, Exercice string, Effet date, Echeance date, PN_ACC double")
    claims = spark.createDataFrame([(b, y, "10", "25,5") for b in ("AUTOMOBILE", "X", "TOTAL", "DOMMAGES CORPORELS", "", "Y") for y in ("2022", "2024", "2024")],
                                   "BRANCHE string, Exercice string, REGLEMENT string, COUT_TOTAL string")
    params = ReservingParams(date_eval=datetime.date(2024, 12, 31), loss_ratios={"AUTOMOBILE": 0.7, "SANTE": 0.8}, guarantee_shares=types, psap_overrides=manual,
                             loss_ratios_split={"AUTO RC": 0.5, "AUTOMOBILE": 0.4, "X": 0.3, "AUTO AR": 0.2}, platform_shares=[("2024", 0.6, 0.4)])
    pipe = ReservingPipeline(policies, claims, params)
    got = {(r.section_no, r.Branche, r.col_name): r.value_double for r in pipe.report().filter("section_no != 2").collect() if r.Branche != "TOTAL"}
    run = pipe.run()
    want = {}
    hidden = {"CU": pipe.policy.cu, "CU agrege": reserves.cu_aggregated(pipe.policy.cu)}
    for no, (name, _, kind, value) in enumerate(SECTIONS, start=1):
        if kind == "matrix":
            table = recap_matrix(hidden[name], value, pipe.policy.years) if name in hidden else run[name]
            for r in table.collect():
                if r["Branche"] != "TOTAL":
                    for c in table.columns[1:]:
                        want[no, r["Branche"], c] = want.get((no, r["Branche"], c), 0.0) + r[c]
    assert {k: v for k, v in want.items() if v} == pytest.approx({k: v for k, v in got.items() if v})
    assert {k[:2] for k in got} == {k[:2] for k in want}


def test_policy_contract(spark):
    import pytest

    from provisio.plans.pipeline import PolicyStage
    df = fx.policies_raw(spark, SF).drop("PN_ACC")
    with pytest.raises(ValueError, match="PN_ACC"):
        PolicyStage(df, fx.fixture_params())
