"""Independent DuckDB formulations of the registered queries.

Written directly from the method's definitions (row-level formulas, GROUP BY
CUBE, PIVOT), not from the Spark plans.  Values are rounded the same way on
both sides: money to cents as floor(x*100+0.5)/100, ratios to 1e-6.
"""

from __future__ import annotations

from provisio.params import AUTO_BRANCH, BODILY_BRANCH, DEFAULT_FRAIS_GENERAUX, GUARANTEE_SHARE_DEFAULTS, TAUX_PREC_MIN
from provisio.sources import fixtures as fx

EVAL = f"DATE '{fx.FIXTURE_DATE_EVAL.isoformat()}'"


def cents(expr: str) -> str:
    return f"(CAST(floor(({expr}) * 100 + 0.5) AS DOUBLE) / CAST(100 AS DOUBLE) + CAST(0 AS DOUBLE))"


def micro(expr: str) -> str:
    return f"(CAST(floor(({expr}) * 1000000 + 0.5) AS DOUBLE) / CAST(1000000 AS DOUBLE) + CAST(0 AS DOUBLE))"


def d(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def _case_map(col: str, mapping: dict) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in sorted(mapping.items()))
    return f"CASE {col} {whens} ELSE {col} END"


def _values(rows: list[tuple], names: str) -> str:
    def lit(v):
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return d(v)
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) v({names}))"


WS_CLASS = r"\t\n\x{0B}\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def ustrip(expr: str) -> str:
    return f"regexp_replace({expr}, '^[{WS_CLASS}]+|[{WS_CLASS}]+$', '', 'g')"


# ---------------------------------------------------------------------------
# Common CTEs
# ---------------------------------------------------------------------------
def base_ctes() -> str:
    m = _case_map("Branche", fx.FIXTURE_MAPPING)
    return f"""
policies_raw AS ({fx.POLICIES_RAW_SQL}),
policies AS (
  SELECT Police, CAST({m} AS VARCHAR) AS Branche, COALESCE(Exercice, 'NR') AS Exercice,
         Effet, Echeance, COALESCE(PN_ACC, CAST(0 AS DOUBLE)) AS PN_ACC
  FROM policies_raw),
years AS (SELECT DISTINCT Exercice FROM policies),
pe_cells AS (SELECT Branche, Exercice, SUM(PN_ACC) AS PE FROM policies GROUP BY Branche, Exercice),
lr AS {_values(sorted(fx.FIXTURE_LOSS_RATIOS.items()), 'Branche, Loss_Ratio')},
pe_last AS (SELECT Branche, SUM(PE) AS PE_Total FROM pe_cells
            WHERE Exercice = (SELECT max(Exercice) FROM pe_cells) GROUP BY Branche),
taux AS (
  SELECT lr.Branche, lr.Loss_Ratio, COALESCE(p.PE_Total, CAST(0 AS DOUBLE)) AS PE_Total,
         COALESCE(p.PE_Total, CAST(0 AS DOUBLE)) / (SELECT SUM(PE_Total) FROM pe_last) * {d(DEFAULT_FRAIS_GENERAUX)} AS FG_Reparti
  FROM lr LEFT JOIN pe_last p ON lr.Branche = p.Branche),
taux_final AS (
  SELECT Branche, Loss_Ratio, PE_Total, FG_Reparti,
         CASE WHEN PE_Total = 0 THEN greatest({d(TAUX_PREC_MIN)}, Loss_Ratio)
              ELSE greatest({d(TAUX_PREC_MIN)}, Loss_Ratio + {d(0.5)} * FG_Reparti / PE_Total) END AS Taux_PREC
  FROM taux),
prec_rows AS (
  SELECT p.*, (p.Echeance - p.Effet) AS duree_totale,
         CASE WHEN {EVAL} > p.Echeance THEN 0
              WHEN p.Effet > {EVAL} THEN (p.Echeance - p.Effet)
              ELSE (p.Echeance - {EVAL}) END AS duree_restante,
         COALESCE(t.Taux_PREC, {d(TAUX_PREC_MIN)}) AS Taux_PREC
  FROM policies p LEFT JOIN taux_final t ON p.Branche = t.Branche),
prec_lines AS (
  SELECT *, COALESCE(CASE WHEN duree_totale = 0 THEN CAST(0 AS DOUBLE)
                          ELSE PN_ACC * (CAST(duree_restante AS DOUBLE) / duree_totale) * Taux_PREC END,
                     CAST(0 AS DOUBLE)) AS PREC
  FROM prec_rows),
prec_cells AS (SELECT Branche, Exercice, SUM(PREC) AS PREC FROM prec_lines GROUP BY Branche, Exercice),
pa_cells AS (
  SELECT e.Branche, e.Exercice, e.PE - COALESCE(r.PREC, 0) AS PA
  FROM pe_cells e LEFT JOIN prec_cells r ON e.Branche = r.Branche AND e.Exercice = r.Exercice
  WHERE e.Branche <> 'TOTAL'),
plat AS {_values([(y, p, h) for y, p, h in fx.FIXTURE_PLATFORM_SHARES], 'Annee, Plateforme, Hors')},
gtype AS {_values(list(GUARANTEE_SHARE_DEFAULTS), 'Type, TP, TH')},
pa_split AS (
  SELECT Branche, Exercice, PA FROM pa_cells WHERE Branche <> '{AUTO_BRANCH}'
  UNION ALL
  SELECT g.Type AS Branche, a.Exercice,
         a.PA * (COALESCE(pl.Plateforme, CAST(0 AS DOUBLE)) * g.TP + COALESCE(pl.Hors, CAST(0 AS DOUBLE)) * g.TH) AS PA
  FROM pa_cells a CROSS JOIN gtype g LEFT JOIN plat pl ON pl.Annee = a.Exercice
  WHERE a.Branche = '{AUTO_BRANCH}'),
lr_split AS {_values(sorted(fx.FIXTURE_LOSS_RATIOS_SPLIT.items()), 'Branche, LR')},
cu_cells AS (
  SELECT s.Branche, s.Exercice, s.PA * COALESCE(l.LR, CAST(0 AS DOUBLE)) AS CU
  FROM pa_split s LEFT JOIN lr_split l ON trim(s.Branche) = l.Branche),
ibnr_rows AS (
  SELECT Exercice, PN_ACC,
         CAST(Echeance - Effet AS DOUBLE) AS D,
         CAST({EVAL} - Effet AS DOUBLE) AS T_raw,
         Echeance
  FROM policies WHERE Branche = '{BODILY_BRANCH}'),
ibnr_m AS (
  SELECT *, CASE WHEN D > 0 THEN greatest(CAST(0 AS DOUBLE), least(D, T_raw)) / D ELSE CAST(0 AS DOUBLE) END AS M,
         CASE WHEN {EVAL} >= Echeance THEN {d(0.05)} ELSE {d(0.95)} - {d(0.90)} * (CASE WHEN D > 0 THEN greatest(CAST(0 AS DOUBLE), least(D, T_raw)) / D ELSE CAST(0 AS DOUBLE) END) END AS LF
  FROM ibnr_rows),
ibnr AS (
  SELECT Exercice, SUM(PN_ACC * M * {d(fx.FIXTURE_LOSS_RATIOS_SPLIT.get(BODILY_BRANCH, 0.72))} * LF) AS IBNR,
         SUM(PN_ACC * M) AS Prime_Acquise,
         SUM(PN_ACC * M * {d(fx.FIXTURE_LOSS_RATIOS_SPLIT.get(BODILY_BRANCH, 0.72))}) AS Charge_Theorique,
         COUNT(*) AS Nb_Contrats
  FROM ibnr_m GROUP BY Exercice)"""


def claims_ctes() -> str:
    from provisio.functions.amounts import AMOUNT_NULL_TOKENS
    toks = ", ".join("'" + t + "'" for t in AMOUNT_NULL_TOKENS)

    def amount(c: str) -> str:
        s = ustrip(f"CAST({c} AS VARCHAR)")
        cleaned = (f"CASE WHEN {s} IS NULL OR length({s}) = 0 THEN NULL "
                   f"WHEN lower({s}) IN ({toks}) THEN NULL "
                   f"WHEN regexp_full_match({s}, '[{WS_CLASS}\\-\\x{{2013}}\\x{{2014}}\\x{{A0}}]+') THEN NULL "
                   f"ELSE {s} END")
        norm = f"regexp_replace(regexp_replace({cleaned}, '^([^,]*),', '\\1.'), '[{WS_CLASS}]+', '', 'g')"
        num = r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?"
        return f"COALESCE(CASE WHEN regexp_full_match({norm}, '{num}') THEN TRY_CAST({norm} AS DOUBLE) END, CAST(0 AS DOUBLE))"

    m = _case_map("b", fx.FIXTURE_MAPPING)
    return f"""
claims_raw AS ({fx.CLAIMS_RAW_SQL}),
claims_norm AS (
  SELECT {ustrip("COALESCE(CAST(BRANCHE AS VARCHAR), '')")} AS b, Exercice,
         {amount('REGLEMENT')} AS Total_Reglement, {amount('COUT_TOTAL')} AS Cout_Total,
         REGLEMENT AS raw_reglement, COUT_TOTAL AS raw_cout
  FROM claims_raw),
claims AS (SELECT CAST({m} AS VARCHAR) AS Branche, Exercice, Total_Reglement, Cout_Total FROM claims_norm),
claims_cells AS (
  SELECT Branche, Exercice, SUM(Total_Reglement) AS Total_Reglement, SUM(Cout_Total) AS Cout_Total,
         CAST(COUNT(*) AS BIGINT) AS Nombre_Sinistres, SUM(Cout_Total) - SUM(Total_Reglement) AS SAP
  FROM claims GROUP BY Branche, Exercice)"""


def with_ctes(*parts: str) -> str:
    return "WITH " + ",".join(p.strip().rstrip(",") for p in parts) + "\n"


# The years of the driver tables (orders and shipments), so that a PIVOT has its columns from the text
YEARS = ["1995", "1996", "1997", "1998", "1999", "2000", "2001"]


def pivot_in(total: bool = True) -> str:
    return "Exercice IN (" + ", ".join(f"'{y}'" for y in [*YEARS, *(["Total"] if total else [])]) + ")"


def matrix_sql(ctes: list[str], cells: str, value: str, years_src: str = "years", money: bool = True,
               cast_int: bool = False, extra_filter: str = "") -> str:
    """Matrix with margins: dense grid, GROUP BY CUBE, PIVOT."""
    agg = "SUM(v)"
    if cast_int:
        agg = "CAST(SUM(v) AS BIGINT)"
    elif money:
        agg = cents("SUM(v)")
    zero = "CAST(0 AS BIGINT)" if cast_int else "CAST(0 AS DOUBLE)"
    mx = f"""
mx_cells AS (SELECT Branche, Exercice, {value} AS v FROM {cells}),
mx_grid AS (SELECT b.Branche, y.Exercice FROM (SELECT DISTINCT Branche FROM mx_cells) b
            CROSS JOIN (SELECT DISTINCT Exercice FROM {years_src}) y),
mx_dense AS (SELECT g.Branche, g.Exercice, COALESCE(c.v, {zero}) AS v FROM mx_grid g
             LEFT JOIN mx_cells c ON c.Branche IS NOT DISTINCT FROM g.Branche AND c.Exercice = g.Exercice),
mx_cube AS (SELECT CASE WHEN grouping(Branche) = 1 THEN 'TOTAL' ELSE Branche END AS Branche,
                   CASE WHEN grouping(Exercice) = 1 THEN 'Total' ELSE Exercice END AS Exercice,
                   {agg} AS v
            FROM mx_dense GROUP BY CUBE (Branche, Exercice))"""
    return with_ctes(*ctes, mx) + f"PIVOT (SELECT * FROM mx_cube {extra_filter}) ON {pivot_in()} USING first(v) GROUP BY Branche\n"
