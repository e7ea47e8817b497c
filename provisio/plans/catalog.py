"""Registered queries (Spark) and their DuckDB oracles.

Every query reads the driver tables through the adapter views and runs the
library operators over whole tables.  Double results are rounded at the very
end (money to cents, ratios to 1e-6) identically on both sides, so the
comparison is insensitive to summation order only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provisio.functions import amounts as amt
from provisio.functions import formatting as fmt
from provisio.functions import text as txt
from provisio.operators import claims as claims_ops
from provisio.operators import mapping as mapping_ops
from provisio.operators import premium, reserves
from provisio.operators import recap as recap_ops
from provisio.operators.recap import recap_matrix
from provisio.params import BODILY_BRANCH, HIDDEN_CU_BRANCHES, PARQUET_ROW_GROUP_ROWS
from provisio.plans import oracle_sql as O
from provisio.plans import pipeline
from provisio.plans import report as report_ops
from provisio.plans.pipeline import ClaimsStage, PolicyStage
from provisio.session import materialize, unsorted_folders
from provisio.operators.exact import exact_cells
from provisio.operators.ordering import branch_order, numbered
from provisio.sources import dimensions as dim
from provisio.sources import fixtures as fx
from provisio.sources import landing
from provisio.sources import production as prod
from provisio.sources.delivery import Delivery, fingerprint_of

RATE_COLS = {"Loss_Ratio", "Taux_PREC", "Plateforme", "Hors", "M", "LF", "share"}


def cents(c: Column) -> Column:
    return F.floor(c * 100 + 0.5).cast("double") / F.lit(100.0) + F.lit(0.0)


def micro(c: Column) -> Column:
    return F.floor(c * 1000000 + 0.5).cast("double") / F.lit(1000000.0) + F.lit(0.0)


def rounded(df: DataFrame) -> DataFrame:
    cols = []
    for name, dtype in df.dtypes:
        c = F.col(f"`{name}`")
        if dtype in ("double", "float"):
            c = (micro(c) if name in RATE_COLS else cents(c)).alias(name)
        cols.append(c)
    return df.select(*cols)


# ---------------------------------------------------------------------------
# Stages (one stored aggregation per scan)
# ---------------------------------------------------------------------------
def policy_stage(spark: SparkSession, sf_dir: str) -> PolicyStage:
    return PolicyStage(fx.policies_raw(spark, sf_dir), fx.fixture_params())


def claims_stage(spark: SparkSession, sf_dir: str) -> ClaimsStage:
    return ClaimsStage(fx.claims_raw(spark, sf_dir), fx.fixture_params())


def both_stages(spark: SparkSession, sf_dir: str) -> tuple[PolicyStage, ClaimsStage]:
    return pipeline.build_stages(fx.policies_raw(spark, sf_dir), fx.claims_raw(spark, sf_dir), fx.fixture_params())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


BASE = O.base_ctes()
CLAIMS = O.claims_ctes()


# ---------------------------------------------------------------------------
# Premium side
# ---------------------------------------------------------------------------
@register("pe_recap_matrix", O.matrix_sql([BASE], "pe_cells", "PE"))
def q_pe_recap_matrix(spark, sf_dir):
    st = policy_stage(spark, sf_dir)
    return rounded(recap_matrix(st.pe, "PE", st.years))


@register("taux_prec", O.with_ctes(BASE) + """
SELECT Branche, """ + O.micro("Loss_Ratio") + """ AS Loss_Ratio, """ + O.cents("PE_Total") + """ AS PE_Total,
       """ + O.cents("FG_Reparti") + """ AS FG_Reparti, """ + O.micro("Taux_PREC") + """ AS Taux_PREC
FROM taux_final""")
def q_taux_prec(spark, sf_dir):
    return rounded(policy_stage(spark, sf_dir).taux)


@register("date_anomalies", O.with_ctes(BASE) + """
SELECT Police, Branche, Effet, Echeance FROM policies WHERE Effet > Echeance""")
def q_date_anomalies(spark, sf_dir):
    return premium.date_anomalies(policy_stage(spark, sf_dir).mapped)   # no per-cell table is made for it


@register("prec_lines", O.with_ctes(BASE) + """
SELECT Police, Branche, Exercice, Effet, Echeance, """ + O.cents("PN_ACC") + """ AS PE,
       duree_totale, duree_restante, """ + O.micro("Taux_PREC") + """ AS Taux_PREC, """ + O.cents("PREC") + """ AS PREC
FROM prec_lines""")
def q_prec_lines(spark, sf_dir):
    st = policy_stage(spark, sf_dir)
    return rounded(premium.prec_lines(st.mapped, st.taux, st.params.date_eval, st.params.taux_min))


@register("prec_recap_matrix", O.matrix_sql([BASE], "prec_cells", "PREC"))
def q_prec_recap_matrix(spark, sf_dir):
    st = policy_stage(spark, sf_dir)
    return rounded(recap_matrix(st.prec, "PREC", st.years))


@register("pa_recap_matrix", O.matrix_sql([BASE], "pa_cells", "PA"))
def q_pa_recap_matrix(spark, sf_dir):
    st = policy_stage(spark, sf_dir)
    return rounded(recap_matrix(st.pa, "PA", st.years))


@register("split_params", O.with_ctes(BASE) + """
SELECT Annee, """ + O.micro("Plateforme") + """ AS Plateforme, """ + O.micro("Hors") + """ AS Hors FROM plat
UNION ALL
SELECT Exercice AS Annee, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE) FROM years WHERE Exercice NOT IN (SELECT Annee FROM plat)""")
def q_split_params(spark, sf_dir):
    st = policy_stage(spark, sf_dir)
    return rounded(premium.split_params(st.mapped, st.params.platform_shares))


@register("pa_split_matrix", O.matrix_sql([BASE], "pa_split", "PA"))
def q_pa_split_matrix(spark, sf_dir):
    st = policy_stage(spark, sf_dir)
    return rounded(recap_matrix(st.pa_split, "PA", st.years))


@register("cu_matrix", O.matrix_sql([BASE], "cu_cells", "CU"))
def q_cu_matrix(spark, sf_dir):
    st = policy_stage(spark, sf_dir)
    return rounded(recap_matrix(st.cu, "CU", st.years))


_CU_AGG = """cu_agg AS (SELECT CASE WHEN Branche IN ('AUTO RC', 'AUTO AR') THEN 'AUTOMOBILE' ELSE Branche END AS Branche,
                  Exercice, SUM(CU) AS CU FROM cu_cells GROUP BY 1, 2)"""


@register("cu_aggregated", O.matrix_sql([BASE, _CU_AGG], "cu_agg", "CU"))
def q_cu_aggregated(spark, sf_dir):
    st = policy_stage(spark, sf_dir)
    return rounded(recap_matrix(reserves.cu_aggregated(st.cu), "CU", st.years, part="_merged"))


_HIDDEN = ", ".join(f"'{b}'" for b in HIDDEN_CU_BRANCHES)


@register("cu_display", O.matrix_sql([BASE], "cu_cells", "CU", extra_filter=f"WHERE Branche NOT IN ({_HIDDEN})"))
def q_cu_display(spark, sf_dir):
    st = policy_stage(spark, sf_dir)
    return rounded(reserves.hide_branches(recap_matrix(st.cu, "CU", st.years)))


@register("ibnr_by_exercice", O.with_ctes(BASE) + """
SELECT Exercice, """ + O.cents("IBNR") + """ AS IBNR, """ + O.cents("Prime_Acquise") + """ AS Prime_Acquise,
       """ + O.cents("Charge_Theorique") + """ AS Charge_Theorique, Nb_Contrats FROM ibnr""")
def q_ibnr_by_exercice(spark, sf_dir):
    return rounded(policy_stage(spark, sf_dir).ibnr)


@register("ibnr_pivot", O.with_ctes(BASE) + """
PIVOT (SELECT 'DOMMAGES CORPORELS' AS Branche, Exercice, """ + O.cents("IBNR") + """ AS v FROM ibnr
       UNION ALL SELECT 'DOMMAGES CORPORELS', 'Total', """ + O.cents("SUM(IBNR)") + """ FROM ibnr)
ON """ + O.pivot_in() + """ USING first(v) GROUP BY Branche""")
def q_ibnr_pivot(spark, sf_dir):
    st = policy_stage(spark, sf_dir)
    ib = st.ibnr
    return rounded(reserves.ibnr_pivot(ib, st.years).select(
        "Branche", *[y for y in st.years if y in set(r[0] for r in ib.select("Exercice").collect())], "Total"))


# ---------------------------------------------------------------------------
# Claims side
# ---------------------------------------------------------------------------
@register("claims_agg", O.with_ctes(CLAIMS) + """
SELECT Branche, Exercice, """ + O.cents("Total_Reglement") + """ AS Total_Reglement, """ + O.cents("Cout_Total") + """ AS Cout_Total,
       Nombre_Sinistres, """ + O.cents("SAP") + """ AS SAP FROM claims_cells""")
def q_claims_agg(spark, sf_dir):
    cl = claims_stage(spark, sf_dir)
    return rounded(cl.cells.orderBy("Branche", "Exercice"))


_CY = "claim_years AS (SELECT DISTINCT Exercice FROM claims_cells)"


@register("claims_nb_matrix", O.matrix_sql([CLAIMS, _CY], "claims_cells", "Nombre_Sinistres", "claim_years", cast_int=True))
def q_claims_nb_matrix(spark, sf_dir):
    st = claims_stage(spark, sf_dir)
    return recap_matrix(st.cells, "Nombre_Sinistres", st.years)


@register("claims_cout_matrix", O.matrix_sql([CLAIMS, _CY], "claims_cells", "Cout_Total", "claim_years"))
def q_claims_cout_matrix(spark, sf_dir):
    st = claims_stage(spark, sf_dir)
    return rounded(recap_matrix(st.cells, "Cout_Total", st.years))


@register("claims_reg_matrix", O.matrix_sql([CLAIMS, _CY], "claims_cells", "Total_Reglement", "claim_years"))
def q_claims_reg_matrix(spark, sf_dir):
    st = claims_stage(spark, sf_dir)
    return rounded(recap_matrix(st.cells, "Total_Reglement", st.years))


@register("claims_sap_matrix", O.matrix_sql([CLAIMS, _CY], "claims_cells", "SAP", "claim_years"))
def q_claims_sap_matrix(spark, sf_dir):
    st = claims_stage(spark, sf_dir)
    return rounded(recap_matrix(st.cells, "SAP", st.years))


# ---------------------------------------------------------------------------
# PSAP
# ---------------------------------------------------------------------------
def _manual_rows():
    from provisio.params import MANUAL_PSAP_BRANCHES
    rows = [(b, y, v) for b, y, v in fx.FIXTURE_PSAP_OVERRIDES if b in MANUAL_PSAP_BRANCHES]
    return rows


_PSAP = f"""
sap_b AS (SELECT Exercice, SAP FROM claims_cells WHERE Branche = '{BODILY_BRANCH}'),
corp AS (
  SELECT y.Exercice, COALESCE(s.SAP, CAST(0 AS DOUBLE)) AS SAP, COALESCE(i.IBNR, CAST(0 AS DOUBLE)) AS IBNR,
         COALESCE(s.SAP, CAST(0 AS DOUBLE)) + COALESCE(i.IBNR, CAST(0 AS DOUBLE)) AS PSAP
  FROM years y LEFT JOIN sap_b s ON s.Exercice = y.Exercice LEFT JOIN ibnr i ON i.Exercice = y.Exercice
  WHERE EXISTS (SELECT 1 FROM ibnr) AND EXISTS (SELECT 1 FROM sap_b)),
manual_in AS {O._values(_manual_rows(), 'Branche, Exercice, PSAP')},
manual AS (
  SELECT b.Branche, y.Exercice, COALESCE(SUM(m.PSAP), CAST(0 AS DOUBLE)) AS PSAP
  FROM (SELECT DISTINCT Branche FROM manual_in) b CROSS JOIN years y
  LEFT JOIN manual_in m ON m.Branche = b.Branche AND m.Exercice = y.Exercice
  GROUP BY b.Branche, y.Exercice),
overrides AS (
  SELECT Branche, Exercice, PSAP FROM manual
  UNION ALL SELECT '{BODILY_BRANCH}' AS Branche, Exercice, PSAP FROM corp),
{_CU_AGG},
cu_grid AS (SELECT b.Branche, y.Exercice FROM (SELECT DISTINCT Branche FROM cu_agg) b CROSS JOIN years y),
psap_base AS (
  SELECT g.Branche, g.Exercice, COALESCE(c.CU, CAST(0 AS DOUBLE)) - COALESCE(r.Total_Reglement, CAST(0 AS DOUBLE)) AS PSAP
  FROM cu_grid g LEFT JOIN cu_agg c ON c.Branche = g.Branche AND c.Exercice = g.Exercice
  LEFT JOIN claims_cells r ON r.Branche = g.Branche AND r.Exercice = g.Exercice),
psap_cells AS (
  SELECT * FROM psap_base WHERE Branche NOT IN (SELECT Branche FROM overrides)
  UNION ALL SELECT * FROM overrides)"""


@register("psap_corporels", O.with_ctes(BASE, CLAIMS, _PSAP) + """
SELECT Exercice, """ + O.cents("SAP") + """ AS SAP, """ + O.cents("IBNR") + """ AS IBNR, """ + O.cents("PSAP") + """ AS "PSAP (SAP+IBNR)" FROM corp
UNION ALL
SELECT 'TOTAL', """ + O.cents("SUM(SAP)") + ", " + O.cents("SUM(IBNR)") + ", " + O.cents("SUM(PSAP)") + """ FROM corp HAVING COUNT(*) > 0""")
def q_psap_corporels(spark, sf_dir):
    st, cl = both_stages(spark, sf_dir)
    corp = reserves.psap_corporels(cl.cells, st.ibnr, st.years)
    return rounded(reserves.psap_corporels_detail(corp))


@register("psap_overrides", O.with_ctes(BASE, CLAIMS, _PSAP) + """
SELECT Branche, Exercice, """ + O.cents("PSAP") + """ AS PSAP FROM overrides""")
def q_psap_overrides(spark, sf_dir):
    return rounded(pipeline.psap_overrides(*both_stages(spark, sf_dir)))


@register("psap_matrix", O.matrix_sql([BASE, CLAIMS, _PSAP], "psap_cells", "PSAP"))
def q_psap_matrix(spark, sf_dir):
    st, cl = both_stages(spark, sf_dir)
    return rounded(recap_matrix(pipeline.psap(st, cl), "PSAP", st.years, part="_merged"))


# ---------------------------------------------------------------------------
# Diagnostics before / after mapping (OP-A3..A7), dimensions (OP-A10, A11, S12)
# ---------------------------------------------------------------------------

_RAW = f"policies_raw AS ({fx.POLICIES_RAW_SQL})"


@register("pe_total", O.with_ctes(_RAW) + "SELECT " + O.cents("SUM(COALESCE(PN_ACC, 0))") + " AS PE_Total FROM policies_raw")
def q_pe_total(spark, sf_dir):
    return rounded(recap_ops.pe_total(fx.policies_raw(spark, sf_dir)))


@register("pe_by_exercice", O.with_ctes(_RAW) + """
SELECT COALESCE(Exercice, 'NR') AS Exercice, """ + O.cents("SUM(COALESCE(PN_ACC, 0))") + """ AS PE, COUNT(*) AS Nb_Lignes
FROM policies_raw GROUP BY 1""")
def q_pe_by_exercice(spark, sf_dir):
    return rounded(recap_ops.pe_by(fx.policies_raw(spark, sf_dir), "Exercice"))


@register("pe_by_branche", O.with_ctes(_RAW) + """
SELECT Branche, """ + O.cents("SUM(COALESCE(PN_ACC, 0))") + """ AS PE, COUNT(*) AS Nb_Lignes
FROM policies_raw GROUP BY 1""")
def q_pe_by_branche(spark, sf_dir):
    return rounded(recap_ops.pe_by(fx.policies_raw(spark, sf_dir), "Branche"))


def _mapped_diag(spark, sf_dir):
    raw = mapping_ops.fill_defaults(fx.policies_raw(spark, sf_dir))
    return raw.withColumn("Branche_Mappee", mapping_ops.map_branch(F.col("Branche").cast("string"), fx.FIXTURE_MAPPING))


@register("pe_after_mapping", O.with_ctes(BASE) + """
SELECT Exercice, Branche AS Branche_Mappee, """ + O.cents("SUM(PN_ACC)") + """ AS PE, COUNT(*) AS Nb_Lignes
FROM policies GROUP BY 1, 2""")
def q_pe_after_mapping(spark, sf_dir):
    return rounded(recap_ops.pe_by(_mapped_diag(spark, sf_dir), "Exercice", "Branche_Mappee"))


@register("pe_after_mapping_pivot", O.with_ctes(BASE, """
pm AS (SELECT Branche AS Branche_Mappee, Exercice, SUM(PN_ACC) AS PE FROM policies GROUP BY 1, 2),
pm_dense AS (SELECT b.Branche_Mappee, y.Exercice, """ + O.cents("COALESCE(pm.PE, 0)") + """ AS PE
             FROM (SELECT DISTINCT Branche_Mappee FROM pm) b CROSS JOIN years y
             LEFT JOIN pm ON pm.Branche_Mappee = b.Branche_Mappee AND pm.Exercice = y.Exercice)""")
          + f"PIVOT pm_dense ON {O.pivot_in(False)} USING first(PE) GROUP BY Branche_Mappee")
def q_pe_after_mapping_pivot(spark, sf_dir):
    st = policy_stage(spark, sf_dir)
    cells = st.pe.withColumnRenamed("Branche", "Branche_Mappee")
    return rounded(recap_ops.pivot_no_totals(cells, "Branche_Mappee", "PE", st.years))


@register("pe_by_exercice_mapped", O.with_ctes(BASE) + """
SELECT Exercice, """ + O.cents("SUM(PN_ACC)") + """ AS PE_Total FROM policies GROUP BY 1""")
def q_pe_by_exercice_mapped(spark, sf_dir):
    st = policy_stage(spark, sf_dir)
    return rounded(st.mapped.groupBy("Exercice").agg(F.sum("PN_ACC").alias("PE_Total")).orderBy("Exercice"))


@register("distinct_branches", O.with_ctes(_RAW) + "SELECT DISTINCT Branche FROM policies_raw WHERE Branche IS NOT NULL")
def q_distinct_branches(spark, sf_dir):
    return mapping_ops.distinct_branches(fx.policies_raw(spark, sf_dir))


@register("distinct_exercices", O.with_ctes(_RAW) + "SELECT DISTINCT COALESCE(Exercice, 'NR') AS Exercice FROM policies_raw")
def q_distinct_exercices(spark, sf_dir):
    return mapping_ops.distinct_exercices(fx.policies_raw(spark, sf_dir))


@register("last_exercice", O.with_ctes(_RAW) + "SELECT max(COALESCE(Exercice, 'NR')) AS last_exercice FROM policies_raw")
def q_last_exercice(spark, sf_dir):
    return mapping_ops.last_exercice(fx.policies_raw(spark, sf_dir))


@register("dataset_stats", O.with_ctes(_RAW) + """
SELECT COUNT(*) AS rows, CAST(6 AS BIGINT) AS columns, 'Police,Branche,Exercice,Effet,Echeance,PN_ACC' AS column_names
FROM policies_raw""")
def q_dataset_stats(spark, sf_dir):
    return prod.dataset_stats(fx.policies_raw(spark, sf_dir))


@register("preview", O.with_ctes(_RAW) + """
SELECT Police, Branche, Exercice, Effet, Echeance, """ + O.cents("PN_ACC") + """ AS PN_ACC FROM policies_raw ORDER BY Police LIMIT 10""")
def q_preview(spark, sf_dir):
    return rounded(prod.preview(fx.policies_raw(spark, sf_dir), order=["Police"]))


# ---------------------------------------------------------------------------
# Mapping helpers (OP-F12, F13), completeness (OP-S11), loss ratios (OP-F11)
# ---------------------------------------------------------------------------
_SET = f"settlements_raw AS ({fx.SETTLEMENTS_RAW_SQL})"


def _targets_sql():
    from provisio.params import TARGET_BRANCHES
    return O._values([(t.upper(), t) for t in TARGET_BRANCHES], "u, target")


@register("default_mapping", O.with_ctes(_SET, f"tg AS {_targets_sql()}") + f"""
SELECT s.Branche_obs, COALESCE(tg.target, 'AUTOMOBILE') AS Branche, tg.target IS NOT NULL AS matched
FROM (SELECT DISTINCT Branche AS Branche_obs FROM settlements_raw WHERE Branche IS NOT NULL) s
LEFT JOIN tg ON tg.u = upper({O.ustrip('s.Branche_obs')})""")
def q_default_mapping(spark, sf_dir):
    return mapping_ops.default_mapping(fx.settlements_raw(spark, sf_dir))


SAVED_MAPPING = dict(fx.FIXTURE_MAPPING, OBSOLETE="VOYAGE")


@register("mapping_stale", O.with_ctes(_RAW, f"saved AS {O._values([(k,) for k in SAVED_MAPPING], 'key')}") + """
SELECT key, 'observed_not_mapped' AS status FROM (SELECT DISTINCT Branche AS key FROM policies_raw WHERE Branche IS NOT NULL) o
WHERE key NOT IN (SELECT key FROM saved)
UNION ALL
SELECT key, 'mapped_not_observed' FROM saved WHERE key NOT IN (SELECT Branche FROM policies_raw WHERE Branche IS NOT NULL)""")
def q_mapping_stale(spark, sf_dir):
    return mapping_ops.mapping_staleness(fx.policies_raw(spark, sf_dir), SAVED_MAPPING)


EXPECTED_YEARS = [str(y) for y in range(1994, 2004)]


@register("missing_years", O.with_ctes(_RAW, f"exp AS {O._values([(y,) for y in EXPECTED_YEARS], 'Exercice')}") + """
SELECT Exercice FROM exp WHERE Exercice NOT IN (SELECT DISTINCT Exercice FROM policies_raw WHERE Exercice IS NOT NULL)""")
def q_missing_years(spark, sf_dir):
    return prod.missing_years(spark, EXPECTED_YEARS, fx.policies_raw(spark, sf_dir))


@register("loss_ratio_resolved", O.with_ctes(BASE) + """
SELECT COALESCE(b.Branche, lr.Branche) AS Branche, """ + O.micro("COALESCE(lr.Loss_Ratio, 0.65)") + """ AS Loss_Ratio
FROM (SELECT DISTINCT Branche FROM policies WHERE Branche IS NOT NULL) b FULL OUTER JOIN lr ON b.Branche = lr.Branche""")
def q_loss_ratio_resolved(spark, sf_dir):
    st = policy_stage(spark, sf_dir)
    return rounded(dim.resolve_loss_ratios(st.mapped, st.params.loss_ratios))


@register("settlements_pivot", O.with_ctes(_SET, """
sc AS (SELECT Branche, Exercice, SUM(Montant) AS Montant FROM settlements_raw GROUP BY 1, 2),
sd AS (SELECT b.Branche, y.Exercice, """ + O.cents("COALESCE(sc.Montant, 0)") + """ AS Montant
       FROM (SELECT DISTINCT Branche FROM sc) b CROSS JOIN (SELECT DISTINCT Exercice FROM sc) y
       LEFT JOIN sc ON sc.Branche = b.Branche AND sc.Exercice = y.Exercice)""")
          + f"PIVOT sd ON {O.pivot_in(False)} USING first(Montant) GROUP BY Branche")
def q_settlements_pivot(spark, sf_dir):
    cells = materialize(dim.settlements_cells(fx.settlements_raw(spark, sf_dir)))
    return rounded(recap_ops.pivot_no_totals(cells, "Branche", "Montant", recap_ops.years_of(cells)))


# ---------------------------------------------------------------------------
# Cleaning functions over whole tables (OP-F3..F9)
# ---------------------------------------------------------------------------

_CRAW = f"claims_raw AS ({fx.CLAIMS_RAW_SQL})"


@register("claims_amount_parse", O.with_ctes(CLAIMS) + """
SELECT raw_reglement AS REGLEMENT, raw_cout AS COUT_TOTAL, """ + O.cents("Total_Reglement") + """ AS Total_Reglement, """ + O.cents("Cout_Total") + """ AS Cout_Total_num
FROM claims_norm""")
def q_claims_amount_parse(spark, sf_dir):
    raw = fx.claims_raw(spark, sf_dir)
    return rounded(raw.select("REGLEMENT", "COUT_TOTAL",
                              amt.claims_amount("REGLEMENT").alias("Total_Reglement"),
                              amt.claims_amount("COUT_TOTAL").alias("Cout_Total_num")))


def _prod_amount_sql(c: str) -> str:
    s = f"replace(regexp_replace(CAST({c} AS VARCHAR), '[{O.WS_CLASS}]+', '', 'g'), ',', '.')"
    num = r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?"
    return f"CASE WHEN regexp_full_match({s}, '{num}') THEN TRY_CAST({s} AS DOUBLE) END"


@register("premium_amount_parse", O.with_ctes(_CRAW) + """
SELECT COUT_TOTAL, """ + O.cents(_prod_amount_sql("COUT_TOTAL")) + """ AS PN_ACC FROM claims_raw""")
def q_premium_amount_parse(spark, sf_dir):
    raw = fx.claims_raw(spark, sf_dir)
    return rounded(raw.select("COUT_TOTAL", amt.production_amount("COUT_TOTAL").alias("PN_ACC")))


@register("branch_clean", O.with_ctes(_CRAW) + """
SELECT BRANCHE AS Branche_raw, """ + O.ustrip("CAST(BRANCHE AS VARCHAR)") + """ AS Branche FROM claims_raw""")
def q_branch_clean(spark, sf_dir):
    raw = fx.claims_raw(spark, sf_dir)
    return raw.select(F.col("BRANCHE").alias("Branche_raw"), txt.clean_branch("BRANCHE").alias("Branche"))


@register("year_clean", """
SELECT o_orderkey, CAST(CAST(year(o_orderdate) AS DOUBLE) AS VARCHAR) AS Exercice_raw,
       """ + O.ustrip("regexp_replace(CAST(CAST(year(o_orderdate) AS DOUBLE) AS VARCHAR), '\\.0$', '')") + """ AS Exercice
FROM orders""")
def q_year_clean(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders")
    raw = F.year("o_orderdate").cast("double").cast("string")
    return o.select("o_orderkey", raw.alias("Exercice_raw"), txt.clean_year(raw).alias("Exercice"))


def _dated_text(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    d = F.col("o_orderdate").cast("date")
    txt_col = (F.when(F.col("o_orderstatus") == "F", F.date_format(d, "dd/MM/yyyy"))
               .when(F.col("o_orderstatus") == "O", F.date_format(d, "yyyy-MM-dd"))
               .otherwise(F.lit("sans date")))
    return o.select("o_orderkey", txt_col.alias("Date d'effet"))


@register("date_coerce", """
WITH t AS (
  SELECT o_orderkey,
         CASE WHEN o_orderstatus = 'F' THEN strftime(CAST(o_orderdate AS DATE), '%d/%m/%Y')
              WHEN o_orderstatus = 'O' THEN strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d')
              ELSE 'sans date' END AS txt
  FROM orders),
p AS (SELECT o_orderkey, txt, COALESCE(CAST(try_strptime(txt, '%d/%m/%Y') AS DATE), CAST(try_strptime(txt, '%Y-%m-%d') AS DATE)) AS d FROM t),
s AS (SELECT COUNT(d) AS ok, COUNT(*) AS n FROM p)
SELECT o_orderkey, CASE WHEN (SELECT ok FROM s) > 0 AND (SELECT ok FROM s) >= 0.4 * (SELECT n FROM s) THEN d END AS "Date d'effet"
FROM p""")
def q_date_coerce(spark, sf_dir):
    return prod.coerce_dates(_dated_text(spark, sf_dir))


# ---------------------------------------------------------------------------
# Formatting and text (OP-F19..F22)
# ---------------------------------------------------------------------------
def _fmt2(x: str) -> str:
    return f"replace(format('{{:,.2f}}', {x}), ',', ' ')"


@register("format_numbers", O.with_ctes(BASE) + """
SELECT Branche, Exercice, """ + _fmt2(O.cents("PE")) + """ AS PE_fmt,
       replace(format('{:,.0f}', CAST(n AS DOUBLE)), ',', ' ') AS Nb_fmt
FROM (SELECT Branche, Exercice, SUM(PN_ACC) AS PE, COUNT(*) AS n FROM policies GROUP BY 1, 2)""")
def q_format_numbers(spark, sf_dir):
    st = policy_stage(spark, sf_dir)
    cells = st.mapped.groupBy("Branche", "Exercice").agg(F.sum("PN_ACC").alias("PE"), F.count(F.lit(1)).alias("Nb"))
    return cells.select("Branche", "Exercice", fmt.fmt_amount(cents(F.col("PE"))).alias("PE_fmt"),
                           fmt.fmt_integer(F.col("Nb")).alias("Nb_fmt"))


def _report_sql(x: str) -> str:
    return (f"CASE WHEN {x} IS NULL THEN '' WHEN abs({x}) >= 1 THEN {_fmt2(x)} "
            f"WHEN {x} = 0 THEN '0,00' ELSE replace(format('{{:.4f}}', {x}), '.', ',') END")


@register("format_report_numbers", O.with_ctes(BASE) + """
SELECT Branche, """ + _report_sql(O.micro("Loss_Ratio")) + """ AS Loss_Ratio, """ + _report_sql(O.cents("PE_Total")) + """ AS PE_Total,
       """ + _report_sql(O.cents("FG_Reparti")) + """ AS FG_Reparti, """ + _report_sql(O.micro("Taux_PREC")) + """ AS Taux_PREC,
       format('{:.2f}', """ + O.micro("Taux_PREC") + """ * 100) || '%' AS Taux_PREC_pct
FROM taux_final""")
def q_format_report_numbers(spark, sf_dir):
    t = rounded(policy_stage(spark, sf_dir).taux)
    return t.select("Branche", *[fmt.fmt_report(c).alias(c) for c in ("Loss_Ratio", "PE_Total", "FG_Reparti", "Taux_PREC")],
                    fmt.fmt_percent("Taux_PREC").alias("Taux_PREC_pct"))


def _sanitize_sql(x: str) -> str:
    src = "".join(a for a, _ in txt.SANITIZE_ONE_TO_ONE).replace("'", "''")
    dst = "".join(b for _, b in txt.SANITIZE_ONE_TO_ONE).replace("'", "''")
    out = f"translate({x}, '{src}', '{dst}')"
    for a, b in txt.SANITIZE_ONE_TO_MANY:
        out = f"replace({out}, '{a}', '{b}')"
    return f"regexp_replace({out}, '[^\\x{{00}}-\\x{{FF}}]', '?', 'g')"


@register("sanitize_text", "SELECT doc_id, " + _sanitize_sql("text") + " AS text FROM documents")
def q_sanitize_text(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents")
    return d.select("doc_id", txt.sanitize_text("text").alias("text"))


# ---------------------------------------------------------------------------
# Report (OP-S5), relaxed union (OP-U1), landing round trips (OP-S1..S4, S10)
# ---------------------------------------------------------------------------


def _report_matrix_sql(no: int, title: str, cells: str, value: str) -> str:
    return f"""SELECT {no} AS section_no, '{title}' AS table_title,
       CASE WHEN grouping(Branche) = 1 THEN 'TOTAL' ELSE Branche END AS Branche,
       CASE WHEN grouping(Exercice) = 1 THEN 'Total' ELSE Exercice END AS col_name,
       CAST(SUM({value}) AS DOUBLE) AS v
FROM {cells} GROUP BY CUBE (Branche, Exercice)"""


def _report_table_sql(no: int, title: str, table: str, cols: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT {no}, '{title}', Branche, '{c}', CAST({c} AS DOUBLE) FROM {table}" for c in cols)


_REPORT_SOURCES = {"PE": "pe_cells", "Taux PREC": "taux_final", "PREC": "prec_cells", "PA": "pa_cells",
                   "PA split": "pa_split", "CU": "cu_cells", "CU agrege": "cu_agg", "Sinistres nombre": "claims_cells",
                   "Sinistres cout": "claims_cells", "Reglements": "claims_cells", "SAP": "claims_cells",
                   "PSAP": "psap_cells"}


def _report_cells_sql() -> str:
    parts = []
    for no, (key, title, kind, value) in enumerate(report_ops.SECTIONS, start=1):
        plain = title.replace("é", "e").replace("è", "e")       # sanitised titles
        if kind == "matrix":
            parts.append(_report_matrix_sql(no, plain, _REPORT_SOURCES[key], value))
        else:
            parts.append(_report_table_sql(no, plain, _REPORT_SOURCES[key], value))
    rounded_v = f"CASE WHEN col_name IN ('Loss_Ratio', 'Taux_PREC') THEN {O.micro('v')} ELSE {O.cents('v')} END"
    return (O.with_ctes(BASE, CLAIMS, _PSAP, "rep AS (" + " UNION ALL ".join(parts) + ")",
                        f"rep_r AS (SELECT section_no, table_title, Branche, col_name, {rounded_v} AS value_double FROM rep)")
            + """SELECT section_no, table_title,
       DENSE_RANK() OVER (PARTITION BY section_no ORDER BY (Branche = 'TOTAL') NULLS FIRST, Branche NULLS FIRST) AS row_no,
       Branche, col_name, value_double, """ + _report_sql("value_double") + """ AS value_text FROM rep_r""")


@register("report_cells", _report_cells_sql())
def q_report_cells(spark, sf_dir):
    rep = pipeline.reserving_report(*both_stages(spark, sf_dir))
    v = F.col("value_double")
    rep = rep.withColumn("value_double", F.when(F.col("col_name").isin("Loss_Ratio", "Taux_PREC"), micro(v)).otherwise(cents(v)))
    return rep.withColumn("value_text", fmt.fmt_report(F.col("value_double")))


def _deliveries(spark, sf_dir):
    """Production delivered in two layouts, each carrying its slot year:
    slots up to 1998 have the premium as dirty text and an extra column,
    later slots are typed.  Two scans of the adapter in total."""
    raw = fx.policies_raw(spark, sf_dir).withColumnRenamed("Exercice", "slot")
    old = raw.filter(F.col("slot") <= "1998").select(
        "slot", "Police", "Branche", "Effet", "Echeance",
        F.regexp_replace(F.col("PN_ACC").cast("decimal(18,2)").cast("string"), r"\.", ",").alias("PN_ACC"),
        F.lit("canal web").alias("Intermediaire"))
    new = raw.filter(F.col("slot") > "1998")
    return [old, new]


@register("union_relaxed", O.with_ctes(_RAW) + """
SELECT Exercice, COUNT(*) AS rows, """ + O.cents("SUM(PN_ACC)") + """ AS PN_ACC,
       COUNT(CASE WHEN Exercice <= '1998' THEN 1 END) AS Intermediaire
FROM policies_raw GROUP BY Exercice""")
def q_union_relaxed(spark, sf_dir):
    u = prod.union_production([(F.col("slot"), d) for d in _deliveries(spark, sf_dir)]).drop("slot")
    return rounded(u.groupBy("Exercice").agg(F.count(F.lit(1)).alias("rows"), F.sum("PN_ACC").alias("PN_ACC"),
                                             F.count("Intermediaire").alias("Intermediaire")))


def _write_text_files(spark, sf_dir, root: str):
    """Write the production deliveries as all-text CSV folders slot=YYYY/ (one
    partitioned write per layout) and return the roots."""
    roots = []
    for k, d in enumerate(_deliveries(spark, sf_dir)):
        path = f"{root}/layout{k}"
        _write_slots(d.select(*[F.col(c).cast("string").alias(c) for c in d.columns]), path)
        roots.append(path)
    return roots


def _write_slots(df: DataFrame, path: str, by: str = "slot", **options) -> None:
    """CSV files below a folder per slot; rows are written as they come."""
    with unsorted_folders(df.sparkSession):
        df.write.mode("overwrite").partitionBy(by).option("header", True).options(**options).csv(path)


def _delivered(spark, roots) -> Delivery:
    """The CSV files under slot=YYYY/ folders of the roots."""
    return Delivery.from_folders(spark, roots)


@register("landing_roundtrip", O.with_ctes(_RAW) + """
SELECT Exercice, COUNT(*) AS rows, """ + O.cents("SUM(PN_ACC)") + """ AS PN_ACC,
       COUNT(Effet) AS n_effet, COUNT(Echeance) AS n_echeance, min(Effet) AS min_effet, max(Echeance) AS max_echeance
FROM policies_raw GROUP BY Exercice""")
def q_landing_roundtrip(spark, sf_dir):
    root = prod.scratch_dir(spark, "landing")
    files = _delivered(spark, _write_text_files(spark, sf_dir, f"{root}/in"))
    target = prod.land_production(spark, files, f"{root}/out")
    landed = prod.read_landed(spark, target)
    return rounded(landed.groupBy("Exercice").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("PN_ACC").alias("PN_ACC"), F.count("Effet").alias("n_effet"),
        F.count("Echeance").alias("n_echeance"), F.min("Effet").alias("min_effet"), F.max("Echeance").alias("max_echeance")))


@register("csv_encoding_fallback", O.with_ctes(CLAIMS) + """
SELECT Branche, Exercice, """ + O.cents("Total_Reglement") + """ AS Total_Reglement, """ + O.cents("Cout_Total") + """ AS Cout_Total,
       Nombre_Sinistres, """ + O.cents("SAP") + """ AS SAP FROM claims_cells""")
def q_csv_encoding_fallback(spark, sf_dir):
    """Claims written as text files, years up to 1998 in Latin-1, later
    years in UTF-8; read back with per-file encoding detection and aggregated."""
    root = prod.scratch_dir(spark, "claims-csv")
    raw = fx.claims_raw(spark, sf_dir).withColumnRenamed("Exercice", "slot")
    for name, enc, cond in (("latin1", "ISO-8859-1", F.col("slot") <= "1998"), ("utf8", "UTF-8", F.col("slot") > "1998")):
        _write_slots(raw.filter(cond), f"{root}/{name}", encoding=enc)
    files = _delivered(spark, [f"{root}/latin1", f"{root}/utf8"])
    claims = dim.read_claims_files(spark, files, fx.FIXTURE_MAPPING)
    return rounded(claims_ops.claims_agg_sorted(claims))


_LINES = """
fp_lines AS (SELECT CAST(Exercice AS VARCHAR) AS slot, Police, Branche, COALESCE(CAST(CAST(PN_ACC AS DECIMAL(18,2)) AS VARCHAR), '') AS amount FROM policies_raw),
fp_numbered AS (SELECT slot, Police || ',' || Branche || ',' || amount AS line, row_number() OVER (PARTITION BY slot ORDER BY Police, Branche, amount) AS pos FROM fp_lines
                UNION ALL SELECT DISTINCT slot, 'Police,Branche,PN_ACC', 0 FROM fp_lines),
fp_hashed AS (SELECT *, CAST('0x' || substr(md5(line), 1, 7) AS BIGINT) AS h FROM fp_numbered),
fp_files AS (SELECT slot, md5(CAST(SUM(strlen(line) + 1) AS VARCHAR) || ':' || COUNT(*) || ':' || hex('Police,Branche,PN_ACC') || ':' ||
                              CAST(CAST(SUM(h) AS HUGEINT) AS VARCHAR) || ':' || CAST(CAST(SUM(h * pos) AS HUGEINT) AS VARCHAR)) AS digest FROM fp_hashed GROUP BY slot),
fp_own AS (SELECT md5(slot || ':production.csv:' || digest) AS m FROM fp_files)"""


@register("fingerprint", O.with_ctes(_RAW, _LINES) + """
SELECT substr(md5(COUNT(*) || ':' || CAST(CAST(SUM(CAST('0x' || substr(m, 1, 15) AS BIGINT)) AS HUGEINT) AS VARCHAR) || ':' ||
                  CAST(CAST(SUM(CAST('0x' || substr(m, 16, 15) AS BIGINT)) AS HUGEINT) AS VARCHAR)), 1, 16) AS fingerprint, COUNT(*) AS files FROM fp_own""")
def q_fingerprint(spark, sf_dir):
    """OP-S10: the digest of a delivery of one file per slot, its lines in order; the writer's random file names are taken
    for one name."""
    root = prod.scratch_dir(spark, "fingerprint")
    raw = fx.policies_raw(spark, sf_dir).select(F.col("Exercice").alias("slot"), "Police", "Branche", F.col("PN_ACC").cast("decimal(18,2)").cast("string").alias("PN_ACC"))
    _write_slots(raw.repartition("slot").sortWithinPartitions("slot", "Police", "Branche", "PN_ACC"), root)
    return fingerprint_of(_delivered(spark, [root]).facts.withColumn("name", F.lit("production.csv")))


@register("claims_distinct_branches", O.with_ctes(CLAIMS) + "SELECT DISTINCT b AS Branche FROM claims_norm WHERE b IS NOT NULL")
def q_claims_distinct_branches(spark, sf_dir):
    """OP-A10 (claims): distinct stripped branches over all claims files, before mapping."""
    return mapping_ops.distinct_branches(claims_ops.normalize_claims(fx.claims_raw(spark, sf_dir)))


@register("claims_cells_stream", O.with_ctes(CLAIMS) + """
SELECT Branche, Exercice, """ + O.cents("Total_Reglement") + """ AS Total_Reglement, """ + O.cents("Cout_Total") + """ AS Cout_Total,
       Nombre_Sinistres, """ + O.cents("SAP") + """ AS SAP FROM claims_cells""")
def q_claims_cells_stream(spark, sf_dir):
    """Claims delivered as text files under Exercice=YYYY/ folders and
    aggregated incrementally (streaming state per cell, availableNow)."""
    from provisio.streaming.landing import maintain_claims_cells, read_cells
    root = prod.scratch_dir(spark, "claims-stream")
    raw = fx.claims_raw(spark, sf_dir)
    _write_slots(raw, f"{root}/in", "Exercice")
    q = maintain_claims_cells(spark, f"{root}/in", ["BRANCHE", "REGLEMENT", "COUT_TOTAL"], fx.FIXTURE_MAPPING,
                              f"{root}/cells", f"{root}/checkpoint")
    q.awaitTermination()                      # an availableNow query ends by itself
    cells = read_cells(spark, f"{root}/cells")
    return rounded(cells.select("Branche", "Exercice", "Total_Reglement", "Cout_Total",
                                F.col("Nombre_Sinistres").cast("bigint").alias("Nombre_Sinistres"), "SAP"))


def _failed_sql(c: str) -> str:
    s = O.ustrip(f"CAST({c} AS VARCHAR)")
    from provisio.functions.amounts import AMOUNT_NULL_TOKENS
    toks = ", ".join("'" + t + "'" for t in AMOUNT_NULL_TOKENS)
    blank = (f"({s} IS NULL OR length({s}) = 0 OR lower({s}) IN ({toks}) "
             f"OR regexp_full_match({s}, '[{O.WS_CLASS}\\-\\x{{2013}}\\x{{2014}}]+'))")
    norm = f"regexp_replace(regexp_replace({s}, '^([^,]*),', '\\1.'), '[{O.WS_CLASS}]+', '', 'g')"
    num = r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?"
    return f"(NOT {blank} AND NOT COALESCE(regexp_full_match({norm}, '{num}') AND TRY_CAST({norm} AS DOUBLE) IS NOT NULL, false))"


@register("claims_parse_quality", O.with_ctes(_CRAW) + f"""
SELECT Exercice, COUNT(*) AS rows, COUNT(CASE WHEN {_failed_sql('REGLEMENT')} THEN 1 END) AS reglement_failed,
       COUNT(CASE WHEN {_failed_sql('COUT_TOTAL')} THEN 1 END) AS cout_failed,
       """ + O.micro(f"CAST(COUNT(CASE WHEN {_failed_sql('REGLEMENT')} THEN 1 END) + COUNT(CASE WHEN {_failed_sql('COUT_TOTAL')} THEN 1 END) AS DOUBLE) / (COUNT(*) * 2)") + """ AS share
FROM claims_raw GROUP BY Exercice""")
def q_claims_parse_quality(spark, sf_dir):
    """SURVEY trap T12: share of non-empty amount cells that silently parse to 0."""
    q = claims_ops.parse_quality(fx.claims_raw(spark, sf_dir))
    return q.select("Exercice", "rows", "reglement_failed", "cout_failed", micro(F.col("share")).alias("share"))


@register("pe_matrix_formatted", O.with_ctes(BASE, """
fm_grid AS (SELECT b.Branche, y.Exercice FROM (SELECT DISTINCT Branche FROM pe_cells) b CROSS JOIN years y),
fm_dense AS (SELECT g.Branche, g.Exercice, COALESCE(c.PE, CAST(0 AS DOUBLE)) AS v FROM fm_grid g
             LEFT JOIN pe_cells c ON c.Branche = g.Branche AND c.Exercice = g.Exercice),
fm_cube AS (SELECT CASE WHEN grouping(Branche) = 1 THEN 'TOTAL' ELSE Branche END AS Branche,
                   CASE WHEN grouping(Exercice) = 1 THEN 'Total' ELSE Exercice END AS Exercice,
                   """ + _fmt2(O.cents("SUM(v)")) + """ AS v
            FROM fm_dense GROUP BY CUBE (Branche, Exercice))""") + f"PIVOT fm_cube ON {O.pivot_in()} USING first(v) GROUP BY Branche")
def q_pe_matrix_formatted(spark, sf_dir):
    """OP-F19 over a presented table: the PE matrix with every amount formatted."""
    st = policy_stage(spark, sf_dir)
    return fmt.format_numeric_columns(rounded(recap_matrix(st.pe, "PE", st.years)))


@register("taux_display", O.with_ctes(BASE) + """
SELECT Branche, format('{:.2f}', """ + O.micro("Loss_Ratio") + """ * 100) || '%' AS Loss_Ratio, """ + O.cents("PE_Total") + """ AS PE_Total,
       """ + _fmt2(O.cents("FG_Reparti")) + """ AS FG_Reparti, format('{:.2f}', """ + O.micro("Taux_PREC") + """ * 100) || '%' AS Taux_PREC
FROM taux_final""")
def q_taux_display(spark, sf_dir):
    """OP-F20: the rate table as displayed (percentages, formatted FG share)."""
    return fmt.taux_display(rounded(policy_stage(spark, sf_dir).taux))


# ---------------------------------------------------------------------------
# File operators over files written from the tables
# ---------------------------------------------------------------------------
def _write_csv(df: DataFrame, path: str, **options) -> str:
    w = df.write.mode("overwrite").option("header", True).option("escape", '"')
    w = w.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).options(**options)
    w.csv(path)
    return path


@register("csv_quoted_cells", """
SELECT doc_id, '"' || text || '", ' || lang || chr(160) AS cell, 'a ""' || source || '"' AS other FROM documents""")
def q_csv_quoted_cells(spark, sf_dir):
    """OP-S3: cells with quotes, commas, line feeds and NBSP, written as CSV and read back."""
    d = fx.table(spark, sf_dir, "documents")
    cells = d.select(F.col("doc_id").cast("string").alias("doc_id"),
                     F.concat(F.lit('"'), "text", F.lit('", '), "lang", F.lit("\u00a0")).alias("cell"),
                     F.concat(F.lit('a ""'), "source", F.lit('"')).alias("other"))
    root = _write_csv(cells, prod.scratch_dir(spark, "quoted"))
    back = _delivered(spark, [root]).rows()
    return back.select(F.col("doc_id").cast("bigint").alias("doc_id"), "cell", "other")


_DELIVERED = "SELECT true AS same, true AS year, true AS name, true AS header, true AS body, true AS line_order, count(*) AS rows FROM policies_raw"


@register("fingerprint_sensitivity", O.with_ctes(_RAW) + _DELIVERED)
def q_fingerprint_sensitivity(spark, sf_dir):
    """OP-S10: which changes of the delivered files change their digest: each but a second look at the same files."""
    root = prod.scratch_dir(spark, "fingerprint")
    # joined and dealt by year once; each version puts the same dealt rows in its order, a task at a time
    raw = materialize(fx.policies_raw(spark, sf_dir).select("Exercice", "Police", "Branche", F.col("PN_ACC").cast("string").alias("PN_ACC")).hint("rebalance", "Exercice"))
    first = F.col("Police") == raw.agg(F.min("Police")).first()[0]
    rows = raw.sortWithinPartitions("Exercice", "Police")
    versions = {"base": rows, "header": rows.withColumnRenamed("PN_ACC", "Prime"),
                "body": rows.withColumn("PN_ACC", F.when(first, F.lit("-1")).otherwise(F.col("PN_ACC"))),
                "line_order": raw.sortWithinPartitions("Exercice", F.desc("Police"))}
    facts = {}
    for name, df in versions.items():
        _write_slots(df.withColumnRenamed("Exercice", "slot"), f"{root}/{name}")
        facts[name] = _delivered(spark, [f"{root}/{name}"]).facts
    of = lambda df: fingerprint_of(df).first()["fingerprint"]
    base = of(facts["base"])
    content = {name: of(f.withColumn("name", F.lit(""))) for name, f in facts.items()}
    told = {"same": prod.fingerprint(spark, _delivered(spark, [f"{root}/base"])).first()["fingerprint"] == base,
            "year": of(facts["base"].withColumn("slot", F.concat("slot", F.lit("x")))) != base,
            "name": of(facts["base"].withColumn("name", F.concat("name", F.lit(".old")))) != base,
            **{name: content[name] != content["base"] for name in ("header", "body", "line_order")}}
    return raw.agg(F.count(F.lit(1)).alias("rows")).select(*[F.lit(told[k]).alias(k) for k in told], "rows")


_RATIOS = """
ratio_rows AS (SELECT p_type AS Branche, CAST(sum(p_size) % 90 + 10 AS DOUBLE) / 100 AS Loss_Ratio FROM part WHERE p_type <> 'PROMO' GROUP BY 1),
ratio_branches AS (SELECT DISTINCT p_type AS Branche FROM part)"""


@register("loss_ratio_file", O.with_ctes(_RATIOS) + """
SELECT 'good' AS file, b.Branche, """ + O.micro("COALESCE(r.Loss_Ratio, 0.65)") + """ AS Loss_Ratio FROM ratio_branches b LEFT JOIN ratio_rows r ON b.Branche = r.Branche
UNION ALL SELECT f.file, b.Branche, """ + O.micro("0.65") + """ FROM ratio_branches b CROSS JOIN (VALUES ('bad cell'), ('java number'), ('no column'), ('no file')) f(file)""")
def q_loss_ratio_file(spark, sf_dir):
    """OP-S6: ratios from a file; one bad cell, a missing column or a missing file gives every branch the default."""
    part = fx.table(spark, sf_dir, "part")
    branches = part.select(F.col("p_type").alias("Branche")).distinct()
    ratios = (part.filter(F.col("p_type") != "PROMO").groupBy("p_type").agg((F.sum("p_size") % 90 + 10).alias("n"))
              .select(F.concat(F.lit("\u00a0"), "p_type", F.lit(" ")).alias("Branche"), (F.col("n") / 100).cast("decimal(4,2)").cast("string").alias("Loss_Ratio")))
    root = prod.scratch_dir(spark, "ratios")
    bad = ratios.withColumn("Loss_Ratio", F.when(F.col("Branche").contains("SMALL"), F.lit("n/a")).otherwise(F.col("Loss_Ratio")))
    java = ratios.withColumn("Loss_Ratio", F.when(F.col("Branche").contains("SMALL"), F.concat("Loss_Ratio", F.lit("d"))).otherwise(F.col("Loss_Ratio")))
    paths = {"good": _write_csv(ratios, f"{root}/good"), "bad cell": _write_csv(bad, f"{root}/bad"), "java number": _write_csv(java, f"{root}/java"),
             "no column": _write_csv(ratios.withColumnRenamed("Loss_Ratio", "LR"), f"{root}/other"), "no file": f"{root}/none.csv"}
    out = None
    for name, path in paths.items():
        got = dim.read_loss_ratios(spark, path, branches).select(F.lit(name).alias("file"), "Branche", "Loss_Ratio")
        out = got if out is None else out.unionByName(got)
    return rounded(out)


@register("override_file", """
WITH y AS (SELECT unnest(['1999', '2000', '2001', '2002']) AS Exercice),
s AS (SELECT CAST(year(o_orderdate) AS VARCHAR) AS Exercice, sum(CAST(o_orderkey % 1000 AS BIGINT)) AS v FROM orders GROUP BY 1)
SELECT 'good' AS file, 'SANTE' AS Branche, y.Exercice, """ + O.cents("CASE WHEN y.Exercice IN ('1999', '2000') THEN COALESCE(s.v, 0) ELSE 0 END") + """ AS PSAP
FROM y LEFT JOIN s ON s.Exercice = y.Exercice
UNION ALL SELECT f.file, 'SANTE', y.Exercice, """ + O.cents("0") + """ FROM y CROSS JOIN (VALUES ('no branch column'), ('no manual branch'), ('java number')) f(file)""")
def q_override_file(spark, sf_dir):
    """OP-S8: manual rows from a file, year headers as text or number; a file without its branch column gives zeros."""
    o = fx.table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("y"), (F.col("o_orderkey") % 1000).alias("v"))
    sums = o.agg(F.sum(F.when(F.col("y") == 1999, F.col("v"))).alias("1999"), F.sum(F.when(F.col("y") == 2000, F.col("v"))).alias("2000.0"))
    rows = sums.select(F.explode(F.array(F.lit("SANTE"), F.lit("TRANSPORT"))).alias("Branche"), "1999", "`2000.0`")
    root, years = prod.scratch_dir(spark, "overrides"), ["1999", "2000", "2001", "2002"]
    paths = {"good": _write_csv(rows, f"{root}/good"), "no branch column": _write_csv(rows.withColumnRenamed("Branche", "B"), f"{root}/none"),
             "no manual branch": _write_csv(rows.filter(F.col("Branche") == "TRANSPORT"), f"{root}/other"),
             "java number": _write_csv(rows.withColumn("1999", F.concat(F.col("1999").cast("string"), F.lit("f"))), f"{root}/java")}
    out = None
    for name, path in paths.items():
        got = dim.read_overrides(spark, path, years).select(F.lit(name).alias("file"), "Branche", "Exercice", "PSAP")
        out = got if out is None else out.unionByName(got)
    return rounded(out)


@register("settlements_file", O.with_ctes(_SET) + """
SELECT Branche, Exercice, """ + O.cents("SUM(Montant)") + """ AS Montant FROM settlements_raw GROUP BY 1, 2""")
def q_settlements_file(spark, sf_dir):
    """OP-S7: settlements written as a text file, read back and summed per cell."""
    path = _write_csv(fx.settlements_raw(spark, sf_dir), prod.scratch_dir(spark, "settlements"))
    return rounded(dim.read_settlements(spark, path))


@register("landing_sanitised", O.with_ctes(_RAW) + """
SELECT Exercice, COUNT(*) AS rows, COUNT(CASE WHEN Exercice > '1998' THEN 1 END) AS empty_text, CAST(0 AS BIGINT) AS null_text, COUNT(Echeance) AS n_echeance
FROM policies_raw GROUP BY Exercice""")
def q_landing_sanitised(spark, sf_dir):
    """OP-F9 in the landing: text a file doesn't have becomes '', typed columns stay typed."""
    root = prod.scratch_dir(spark, "sanitised")
    files = _delivered(spark, _write_text_files(spark, sf_dir, f"{root}/in"))
    landed = prod.read_landed(spark, prod.land_production(spark, files, f"{root}/out", sanitise=True))
    return landed.groupBy("Exercice").agg(
        F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("Intermediaire") == "", 1)).alias("empty_text"),
        F.count(F.when(F.col("Intermediaire").isNull() | F.col("Police").isNull(), 1)).alias("null_text"), F.count("Echeance").alias("n_echeance"))


#: header spellings of a claims file by the last digit of its year
_SPELLINGS = [["BRANCHE", "REGLEMENT", "COUT_TOTAL"], ["Branche", "Total  Règlement", "Coût  Total"], ["branche", "Montant reglement net", "Cout total brut"]]


@register("claims_header_variants", O.with_ctes(CLAIMS) + """
SELECT Branche, Exercice, """ + O.cents("Total_Reglement") + """ AS Total_Reglement, """ + O.cents("Cout_Total") + """ AS Cout_Total,
       Nombre_Sinistres, """ + O.cents("SAP") + """ AS SAP FROM claims_cells""")
def q_claims_header_variants(spark, sf_dir):
    """OP-F1..F3: claims files whose headers are spelled in three ways, resolved per layout."""
    root = prod.scratch_dir(spark, "headers")
    raw = fx.claims_raw(spark, sf_dir).withColumnRenamed("Exercice", "slot")
    roots = []
    for i, names in enumerate(_SPELLINGS):
        own = raw.filter(F.col("slot").cast("int") % len(_SPELLINGS) == i)
        df = own.select(F.col("BRANCHE").alias(names[0]), F.col("REGLEMENT").alias(names[1]), F.col("COUT_TOTAL").alias(names[2]), "slot")
        _write_slots(df, f"{root}/{i}", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
        roots.append(f"{root}/{i}")
    return rounded(claims_ops.claims_agg_sorted(dim.read_claims_files(spark, _delivered(spark, roots), fx.FIXTURE_MAPPING)))


# ---------------------------------------------------------------------------
# Landing by change, contract, pruning, row groups, types, order, exact sums
# ---------------------------------------------------------------------------
_LATER = "1997"


@register("landing_incremental", O.with_ctes(_RAW) + f"""
SELECT Exercice, COUNT(*) AS rows, {O.cents(f"SUM(PN_ACC) + CASE WHEN Exercice = '{_LATER}' THEN COUNT(PN_ACC) ELSE 0 END")} AS PN_ACC,
       CASE WHEN Exercice = '{_LATER}' THEN COUNT(*) ELSE 0 END AS rewritten, CASE WHEN Exercice = '{_LATER}' THEN 'landed' ELSE 'kept' END AS status
FROM policies_raw GROUP BY Exercice""")
def q_landing_incremental(spark, sf_dir):
    """OP-S10: a delivery landed twice; in between, one slot's premiums have gone up by one.  Only its rows are written anew."""
    root = prod.scratch_dir(spark, "changes")
    raw = fx.policies_raw(spark, sf_dir).withColumnRenamed("Exercice", "slot")
    text = lambda df: df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
    _write_slots(text(raw), f"{root}/in")
    landing.land_changes(spark, _delivered(spark, [f"{root}/in"]), f"{root}/table")
    file = F.col("_metadata.file_name").alias("file")
    first = materialize(landing.read_changes_landed(spark, f"{root}/table").select(file).distinct())
    text(raw.filter(F.col("slot") == _LATER).withColumn("PN_ACC", F.col("PN_ACC") + 1).drop("slot")).write.mode("overwrite").option("header", True).csv(f"{root}/in/slot={_LATER}")
    touched = landing.land_changes(spark, _delivered(spark, [f"{root}/in"]), f"{root}/table")
    now = landing.read_changes_landed(spark, f"{root}/table").select("Exercice", "PN_ACC", file)
    now = now.join(first.withColumn("old", F.lit(True)), "file", "left")
    cells = now.groupBy("Exercice").agg(F.count(F.lit(1)).alias("rows"), F.sum("PN_ACC").alias("PN_ACC"), F.count(F.when(F.col("old").isNull(), 1)).alias("rewritten"))
    return rounded(cells.join(touched, cells.Exercice == touched.slot, "left").select("Exercice", "rows", "PN_ACC", "rewritten", F.coalesce("status", F.lit("kept")).alias("status")))


@register("landing_rejections", O.with_ctes(_RAW) + """
SELECT Exercice AS slot, CASE WHEN Exercice <= '1998' THEN 'Effet, PN_ACC' ELSE 'Branche' END AS missing,
       CASE WHEN Exercice <= '1998' THEN 'Police, Branche, Echeance' ELSE 'Police, Effet, PN_ACC, Echeance' END AS found,
       CASE WHEN Exercice <= '1998' THEN 'Police, Branche, Echeance, Prime' ELSE 'Police, Effet, Echeance, PN_ACC' END AS available, COUNT(*) AS rows
FROM policies_raw WHERE Exercice <= '1996' OR Exercice > '1998' GROUP BY Exercice""")
def q_landing_rejections(spark, sf_dir):
    """OP-S14: what the files of a delivery lack, as rows; a layout that has all is not among them."""
    root = prod.scratch_dir(spark, "rejections")
    raw = fx.policies_raw(spark, sf_dir).withColumnRenamed("Exercice", "slot")
    raw = raw.select("slot", *[F.col(c).cast("string").alias(c) for c in raw.columns if c != "slot"])
    early, late, y = F.col("slot") <= "1996", F.col("slot") > "1998", "slot"
    layouts = [raw.filter(early).select(y, "Police", "Branche", "Echeance", F.col("PN_ACC").alias("Prime")), raw.filter(late).select(y, "Police", "Effet", "Echeance", "PN_ACC"),
               raw.filter(~early & ~late)]
    for i, df in enumerate(layouts):
        _write_slots(df, f"{root}/{i}")
    given = _delivered(spark, [f"{root}/{i}" for i in range(len(layouts))])
    bad = given.rejections(["Police", "Branche", "Effet", "PN_ACC", "Echeance"])
    rows = given.facts.select("slot", F.col("name").alias("file"), (F.col("lines") - 1).alias("n"))
    return bad.join(rows, ["slot", "file"]).groupBy("slot", "missing", "found", "available").agg(F.sum("n").cast("bigint").alias("rows"))


@register("last_year_landed", O.with_ctes(_RAW) + """
SELECT Exercice, Branche, COUNT(*) AS rows, """ + O.cents("SUM(PN_ACC)") + """ AS PN_ACC FROM policies_raw
WHERE Exercice = (SELECT max(Exercice) FROM policies_raw) GROUP BY ALL""")
def q_last_year_landed(spark, sf_dir):
    """OP-P1 / OP-S9: the last year of the landed table, found while the query runs; other partitions aren't read."""
    path = f"{prod.scratch_dir(spark, 'last-year')}/table"
    prod.write_production(fx.policies_raw(spark, sf_dir), path)
    last = prod.last_year_landed(prod.read_landed(spark, path))
    return rounded(last.groupBy("Exercice", "Branche").agg(F.count(F.lit(1)).alias("rows"), F.sum("PN_ACC").alias("PN_ACC")))


@register("landed_row_groups", O.with_ctes(_RAW) + """
SELECT Exercice, COUNT(*) AS rows, CAST(0 AS BIGINT) AS groups_over_limit, true AS groups_hold_all FROM policies_raw GROUP BY Exercice""")
def q_landed_row_groups(spark, sf_dir):
    """OP-S4: the landed files' footers, read back: no row group over 100 000 rows, and their rows are all rows."""
    path = f"{prod.scratch_dir(spark, 'groups')}/table"
    prod.write_production(fx.policies_raw(spark, sf_dir), path)
    groups = prod.row_groups(spark, path).groupBy("Exercice").agg(
        F.sum("rows").alias("in_groups"), F.count(F.when(F.col("rows") > PARQUET_ROW_GROUP_ROWS, 1)).alias("groups_over_limit"))
    rows = prod.read_landed(spark, path).groupBy("Exercice").agg(F.count(F.lit(1)).alias("rows"))
    return rows.join(groups, "Exercice").select("Exercice", "rows", "groups_over_limit", (F.col("rows") == F.col("in_groups")).alias("groups_hold_all"))


@register("union_supertypes", O.with_ctes(_RAW) + """
SELECT Exercice, COUNT(*) AS rows, min(extra) AS min_extra, max(extra) AS max_extra, """ + O.cents("SUM(n)") + """ AS n, strftime(max(t), '%Y-%m-%d %H:%M:%S') AS last
FROM (SELECT Exercice, CASE WHEN Exercice <= '1996' THEN CAST(length(Police) AS VARCHAR) WHEN Exercice <= '1998' THEN CAST(length(Police) + 0.5::DOUBLE AS VARCHAR)
                            ELSE CAST(Effet AS VARCHAR) END AS extra,
             CASE WHEN Exercice <= '1996' THEN CAST(length(Branche) AS DOUBLE) WHEN Exercice <= '1998' THEN 1::DOUBLE ELSE PN_ACC END AS n,
             CASE WHEN Exercice <= '1996' THEN CAST(Effet AS TIMESTAMP) WHEN Exercice <= '1998' THEN CAST(Effet AS TIMESTAMP) + INTERVAL 7 HOUR END AS t FROM policies_raw)
GROUP BY Exercice""")
def q_union_supertypes(spark, sf_dir):
    """OP-U1: columns that files of three kinds hold in three types: whole numbers, fractions and dates meet as text,
    whole numbers, truth values and fractions as fractions, dates and times as times."""
    raw = fx.policies_raw(spark, sf_dir).withColumnRenamed("Exercice", "slot").select("slot", "Police", "Branche", "Effet", "PN_ACC")
    early, late = F.col("slot") <= "1996", F.col("slot") > "1998"
    a = raw.filter(early).select("*", F.length("Police").alias("Extra"), F.length("Branche").cast("bigint").alias("n"), F.col("Effet").alias("t"))
    b = raw.filter(~early & ~late).select("*", (F.length("Police") + F.lit(0.5)).alias("extra"), (F.length("Branche") > 0).alias("N"),
                                          (F.col("Effet").cast("timestamp_ntz") + F.expr("INTERVAL 7 HOUR")).alias("t"))
    c = raw.filter(late).select("*", F.col("Effet").alias("EXTRA"), F.col("PN_ACC").alias("n"))
    u = prod.union_production([(F.col("slot"), d) for d in (a, b, c)])
    return rounded(u.groupBy("Exercice").agg(F.count(F.lit(1)).alias("rows"), F.min("extra").alias("min_extra"), F.max("extra").alias("max_extra"),
                                             F.sum("n").alias("n"), F.date_format(F.max("t"), "yyyy-MM-dd HH:mm:ss").alias("last")))


@register("recap_ordered", O.with_ctes(BASE) + """
SELECT row_number() OVER (ORDER BY (Branche = 'TOTAL'), Branche NULLS FIRST) AS row_no, Branche, Total FROM (
  SELECT CASE WHEN grouping(Branche) = 1 THEN 'TOTAL' ELSE Branche END AS Branche, """ + O.cents("SUM(PE)") + """ AS Total FROM pe_cells GROUP BY ROLLUP (Branche))""")
def q_recap_ordered(spark, sf_dir):
    """OP-O1: the lines of the PE matrix, numbered in their order."""
    st = policy_stage(spark, sf_dir)
    return numbered(rounded(recap_matrix(st.pe, "PE", st.years)).select("Branche", "Total"), branch_order())


@register("claims_ordered", O.with_ctes(CLAIMS) + """
SELECT row_number() OVER (ORDER BY Branche NULLS FIRST, Exercice NULLS FIRST) AS row_no, Branche, Exercice, Nombre_Sinistres, """ + O.cents("SAP") + """ AS SAP FROM claims_cells""")
def q_claims_ordered(spark, sf_dir):
    """OP-O2: the claims cells, numbered by (Branche, Exercice)."""
    cells = rounded(claims_stage(spark, sf_dir).cells).select("Branche", "Exercice", "Nombre_Sinistres", "SAP")
    return numbered(cells, [F.col("Branche").asc_nulls_first(), F.col("Exercice").asc_nulls_first()])


@register("policies_ordered", O.with_ctes(_RAW) + """
SELECT row_number() OVER (ORDER BY Exercice, Branche, Police) AS row_no, Exercice, Branche, Police FROM policies_raw""")
def q_policies_ordered(spark, sf_dir):
    """OP-O2 over rows: every policy, numbered by (Exercice, Branche, Police), dealt over ranges of this order."""
    rows = fx.policies_raw(spark, sf_dir).select("Exercice", "Branche", "Police")
    return numbered(rows, [F.col(c).asc_nulls_first() for c in rows.columns])


@register("pe_exact_total", O.with_ctes(_RAW) + """
SELECT Branche, Exercice, CAST(SUM(CAST(PN_ACC AS DECIMAL(18,4))) * 10000 AS BIGINT) AS PE_units, COUNT(*) AS Nb, true AS same FROM policies_raw GROUP BY Branche, Exercice
UNION ALL SELECT 'TOTAL', 'TOTAL', CAST(SUM(CAST(PN_ACC AS DECIMAL(18,4))) * 10000 AS BIGINT), COUNT(*), true FROM policies_raw""")
def q_pe_exact_total(spark, sf_dir):
    """OP-A1 / OP-A3: premiums in units of 1/10000, per cell and in all, summed over three partitionings that agree to the last unit."""
    raw = fx.policies_raw(spark, sf_dir).select("Police", "Branche", "Exercice", "PN_ACC")
    dealt = [raw, raw.repartition(5, "Police"), raw.repartitionByRange(3, "PN_ACC")]
    cells = None
    for i, df in enumerate(dealt):
        own = exact_cells(df, {"PE": "PN_ACC"}).withColumn("way", F.lit(i))
        cells = own if cells is None else cells.unionByName(own)
    cells = cells.groupingSets([["Branche", "Exercice", "way"], ["way"]], "Branche", "Exercice", "way").agg(
        F.sum("PE").alias("PE"), F.sum("Nb").alias("Nb"), F.grouping("Branche").alias("all"))
    name = lambda c: F.when(F.col("all") == 1, F.lit("TOTAL")).otherwise(F.col(c)).alias(c)
    units = (F.col("PE") * 10000).cast("bigint")
    return cells.select(name("Branche"), name("Exercice"), units.alias("u"), "Nb").groupBy("Branche", "Exercice").agg(
        F.max("u").alias("PE_units"), F.max("Nb").cast("bigint").alias("Nb"), ((F.min("u") == F.max("u")) & (F.count(F.lit(1)) == len(dealt))).alias("same"))


@register("claims_exact_agg", O.with_ctes(CLAIMS) + """
SELECT Branche, Exercice, CAST(SUM(CAST(Total_Reglement AS DECIMAL(18,4))) * 10000 AS BIGINT) AS paid_units,
       CAST(SUM(CAST(Cout_Total AS DECIMAL(18,4))) * 10000 AS BIGINT) AS cost_units, COUNT(*) AS Nb FROM claims GROUP BY Branche, Exercice""")
def q_claims_exact_agg(spark, sf_dir):
    """OP-A8: paid and cost per cell, exactly, in units of 1/10000."""
    rows = claims_ops.map_claims(fx.claims_raw(spark, sf_dir), fx.FIXTURE_MAPPING)
    cells = exact_cells(rows, {"paid": "Total_Reglement", "cost": "Cout_Total"})
    return cells.select("Branche", "Exercice", *[(F.col(c) * 10000).cast("bigint").alias(f"{c}_units") for c in ("paid", "cost")], "Nb")


@register("date_coerce_files", """
WITH t AS (
  SELECT o_orderkey, CAST(year(o_orderdate) AS VARCHAR) AS slot,
         CASE WHEN year(o_orderdate) % 2 = 0 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'sans date' ELSE strftime(o_orderdate, '%d/%m/%Y') END
              WHEN o_orderkey % 4 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'ref ' || o_orderkey END AS txt FROM orders),
p AS (SELECT *, COALESCE(CAST(try_strptime(txt, '%d/%m/%Y') AS DATE), CAST(try_strptime(txt, '%Y-%m-%d') AS DATE)) AS d FROM t),
s AS (SELECT slot, COUNT(d) > 0 AND COUNT(d) >= 0.4 * COUNT(*) AS ok FROM p GROUP BY slot)
SELECT o_orderkey, p.slot, CASE WHEN ok THEN strftime(d, '%Y-%m-%d') ELSE txt END AS souscription FROM p JOIN s ON p.slot = s.slot""")
def q_date_coerce_files(spark, sf_dir):
    """OP-F8 over delivered files: a date column that some files accept and others don't is text, with ISO dates where it is
    accepted; a file that accepts it loses what isn't a date."""
    root = prod.scratch_dir(spark, "date-files")
    o, k = fx.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d")), F.col("o_orderkey")
    even = F.when(k % 3 == 0, F.lit("sans date")).otherwise(F.date_format("d", "dd/MM/yyyy"))
    odd = F.when(k % 4 == 0, F.date_format("d", "yyyy-MM-dd")).otherwise(F.concat(F.lit("ref "), k.cast("string")))
    y = F.year("d")
    rows = o.select(y.cast("string").alias("slot"), k.cast("string").alias("Police"), F.when(y % 2 == 0, even).otherwise(odd).alias("Date de souscription"))
    _write_slots(rows.repartition("slot"), root)
    typed = prod.coerce_dates_by_file(_delivered(spark, [root]).rows())
    return typed.select(F.col("Police").cast("bigint").alias("o_orderkey"), F.col("__slot").alias("slot"), F.col("Date de souscription").alias("souscription"))


@register("claims_rejections", O.with_ctes(f"claims_raw AS ({fx.CLAIMS_RAW_SQL})") + """
SELECT Exercice AS slot, CASE WHEN Exercice <= '1996' THEN 'COUT_TOTAL' ELSE 'BRANCHE, REGLEMENT' END AS missing,
       CASE WHEN Exercice <= '1996' THEN 'Branche=BRANCHE, Total_Reglement=REGLEMENT' ELSE 'Cout_Total=Coût  total' END AS found,
       CASE WHEN Exercice <= '1996' THEN 'BRANCHE, REGLEMENT' ELSE 'Branche produit, Coût  total' END AS available, COUNT(*) AS rows
FROM claims_raw WHERE Exercice <= '1996' OR Exercice > '1998' GROUP BY Exercice""")
def q_claims_rejections(spark, sf_dir):
    """OP-S14 of claims: what each file lacks of the contract, what was found and what there is, as rows."""
    root = prod.scratch_dir(spark, "claims-rejections")
    raw = fx.claims_raw(spark, sf_dir).withColumnRenamed("Exercice", "slot")
    early, late = F.col("slot") <= "1996", F.col("slot") > "1998"
    layouts = [raw.filter(early).select("slot", "BRANCHE", "REGLEMENT"), raw.filter(late).select("slot", F.col("BRANCHE").alias("Branche produit"), F.col("COUT_TOTAL").alias("Coût  total")),
               raw.filter(~early & ~late)]
    for i, df in enumerate(layouts):
        _write_slots(df, f"{root}/{i}")
    given = _delivered(spark, [f"{root}/{i}" for i in range(len(layouts))])
    rows = given.facts.select("slot", F.col("name").alias("file"), (F.col("lines") - 1).alias("n"))
    return given.rejections().join(rows, ["slot", "file"]).groupBy("slot", "missing", "found", "available").agg(F.sum("n").cast("bigint").alias("rows"))


@register("delivery_layouts", O.with_ctes(f"claims_raw AS ({fx.CLAIMS_RAW_SQL})") + """
SELECT CASE CAST(Exercice AS INTEGER) % 3 WHEN 0 THEN 'BRANCHE, REGLEMENT, COUT_TOTAL' WHEN 1 THEN 'Branche, Total  Règlement, Coût  Total'
            ELSE 'branche, Montant reglement net, Cout total brut' END AS names,
       CAST(Exercice AS INTEGER) % 3 <> 1 AS utf8, COUNT(DISTINCT Exercice) AS files, COUNT(*) + COUNT(DISTINCT Exercice) AS lines
FROM claims_raw GROUP BY 1, 2""")
def q_delivery_layouts(spark, sf_dir):
    """OP-F1..F3 over a delivery: its layouts, one row each however many files share it; the accented one is Latin-1."""
    root = prod.scratch_dir(spark, "layouts")
    raw = fx.claims_raw(spark, sf_dir).withColumnRenamed("Exercice", "slot").withColumn("BRANCHE", F.translate("BRANCHE", "\u00a0", "_"))
    raw = raw.withColumn("REGLEMENT", F.translate("REGLEMENT", "\u00a0", " ")).withColumn("COUT_TOTAL", F.translate("COUT_TOTAL", "\u00a0", " ")).repartition("slot")
    for i, names in enumerate(_SPELLINGS):
        own = raw.filter(F.col("slot").cast("int") % len(_SPELLINGS) == i)
        df = own.select("slot", *[F.col(c).alias(n) for c, n in zip(_SPELLINGS[0], names)])
        _write_slots(df, f"{root}/{i}", encoding="ISO-8859-1" if i == 1 else "UTF-8")
    return _delivered(spark, [f"{root}/{i}" for i in range(len(_SPELLINGS))]).layout_table()
