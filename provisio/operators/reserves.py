"""Reserve side: CU, aggregated CU, IBNR, bodily-injury PSAP, overrides, PSAP
(OP-R6..R11, OP-J4..J6, OP-P3..P5).

All inputs here are per-cell frames (at most #branches x #years rows).  Dense
grids are produced by exploding the known year list per branch, not by
joins, and every lookup parameter is a map literal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provisio.functions.text import ustrip
from provisio.operators.literal import literal_frame
from provisio.operators.mapping import map_literal
from provisio.operators.recap import recap_matrix
from provisio.params import (
    AUTO_AR, AUTO_BRANCH, AUTO_RC, BODILY_BRANCH, HIDDEN_CU_BRANCHES, MANUAL_PSAP_BRANCHES, TOTAL_ROW,
)


def _stripped_ratios(loss_ratios: dict) -> dict:
    out: dict = {}
    for k, v in loss_ratios.items():       # last duplicate after strip wins
        out[str(k).strip()] = float(v)
    return out


def cu_ratio(branch: Column, loss_ratios: dict) -> Column:
    """The loss ratio of a stripped branch, 0 without one."""
    lr = _stripped_ratios(loss_ratios)
    return F.coalesce(F.try_element_at(map_literal(lr), branch), F.lit(0.0)) if lr else F.lit(0.0)


def cu_cells(pa: DataFrame, loss_ratios: dict, value: str = "PA") -> DataFrame:
    """OP-R6: CU = PA * LR(stripped branch), missing ratio -> 0."""
    b = ustrip(F.col("Branche"))
    return (pa.withColumn("Branche", b).filter(F.col("Branche") != TOTAL_ROW)
            .select("Branche", "Exercice", (F.col(value) * cu_ratio(F.col("Branche"), loss_ratios)).alias("CU")))


def cu_aggregated(cu: DataFrame) -> DataFrame:
    """OP-R7: AUTO RC + AUTO AR -> one AUTOMOBILE row, other rows unchanged; a
    branch that is called AUTOMOBILE already stays a row of its own, told
    apart by ``_merged``."""
    split = F.col("Branche").isin([AUTO_RC, AUTO_AR])
    name = F.when(split, F.lit(AUTO_BRANCH)).otherwise(F.col("Branche"))
    return (cu.select(name.alias("Branche"), "Exercice", split.alias("_merged"), "CU")
            .groupBy("Branche", "Exercice", "_merged").agg(F.sum("CU").alias("CU")))


def hide_branches(matrix: DataFrame, hidden: list[str] = HIDDEN_CU_BRANCHES) -> DataFrame:
    """OP-P5: display mask applied after totals (TOTAL still includes them)."""
    return matrix.filter(~F.col("Branche").isin(hidden) | F.col("Branche").isNull())


def ibnr_by_exercice(cells_df: DataFrame) -> DataFrame:
    """OP-R8 detail: per year of the bodily-injury branch."""
    return (cells_df.filter(F.col("Branche") == BODILY_BRANCH)
            .groupBy("Exercice")
            .agg(F.sum("IBNR").alias("IBNR"), F.sum("Prime_Acquise").alias("Prime_Acquise"),
                 F.sum("Charge_Theorique").alias("Charge_Theorique"), F.sum("Nb").alias("Nb_Contrats"))
            .orderBy("Exercice"))


def ibnr_pivot(ibnr: DataFrame, years: list[str]) -> DataFrame:
    """OP-R8 pivot: one row, the years that have IBNR, and Total."""
    m = recap_matrix(ibnr.withColumn("Branche", F.lit(BODILY_BRANCH)), "IBNR", years)
    return m.filter(F.col("Branche") != TOTAL_ROW)


def _tagged(df: DataFrame, kind: str, value, branch=None, merged=None) -> DataFrame:
    value = F.col(value) if isinstance(value, str) else value
    return df.select((F.col("Branche") if branch is None else branch).alias("Branche"), "Exercice", value.cast("double").alias("v"),
                     (F.lit(False) if merged is None else merged).alias("_merged"), F.lit(kind).alias("_kind"))


def has_kind(kind: str) -> Column:
    """Whether a group of tagged rows has one of ``kind``."""
    return F.bool_or(F.col("_kind") == kind).alias(f"has_{kind}")


def gathered() -> Column:
    """The tagged rows of a group as one array (a branch's cells: a few per year)."""
    return F.collect_list(F.struct("Exercice", "_kind", "v")).alias("_rows")


def year_sum(year: Column, *kinds: str) -> Column:
    """The sum of a year's gathered rows of some kinds, 0 without any."""
    own = F.filter("_rows", lambda r: (r["Exercice"] == year) & r["_kind"].isin(*kinds))
    return F.aggregate(own, F.lit(0.0), lambda a, r: a + F.coalesce(r["v"], F.lit(0.0)))


def _unfolded(groups: DataFrame, years: list[str], *keep: str, **values) -> DataFrame:
    """A row per group and year; a value is a function of the year."""
    cells = F.transform(F.lit(sorted(years)).cast("array<string>"), lambda y: F.struct(y.alias("Exercice"), *[v(y).alias(n) for n, v in values.items()]))
    return groups.select(*keep, F.inline(cells))


def psap_corporels(sap_cells: DataFrame, ibnr: DataFrame, years: list[str]) -> DataFrame:
    """OP-R9: SAP + IBNR of the bodily-injury branch per CU year (missing = 0).

    Empty unless both an IBNR and a SAP row exist for the branch.  One
    aggregate over the tagged rows of both sides."""
    rows = _tagged(sap_cells.filter(F.col("Branche") == BODILY_BRANCH), "sap", "SAP").unionByName(
        _tagged(ibnr, "ibnr", "IBNR", branch=F.lit(BODILY_BRANCH)))
    both = rows.groupBy("Branche").agg(gathered(), has_kind("sap"), has_kind("ibnr")).filter("has_sap AND has_ibnr")
    return (_unfolded(both, years, SAP=lambda y: year_sum(y, "sap"), IBNR=lambda y: year_sum(y, "ibnr"))
            .withColumn("PSAP", F.col("SAP") + F.col("IBNR")))


def psap_corporels_detail(corp: DataFrame) -> DataFrame:
    """OP-R9 display table: years then a TOTAL row."""
    out = corp.rollup("Exercice").agg(F.sum("SAP").alias("SAP"), F.sum("IBNR").alias("IBNR"),
                                      F.sum("PSAP").alias("PSAP (SAP+IBNR)"), F.grouping_id().alias("_g"))
    out = out.filter(F.col("PSAP (SAP+IBNR)").isNotNull())     # no row at all without a year
    return (out.select(F.when(F.col("_g") == 1, F.lit(TOTAL_ROW)).otherwise(F.col("Exercice")).alias("Exercice"),
                       "SAP", "IBNR", "PSAP (SAP+IBNR)", "_g")
            .orderBy("_g", "Exercice").drop("_g"))


def manual_overrides(user_overrides: list, years: list[str]) -> list[tuple[str, str, float]]:
    """OP-S8: (Branche, Exercice, PSAP) of every manual branch and year: the
    given amounts (summed, 0 where none is given), or zeros for every manual
    branch when none has any.  Parameters of the run, held by the driver."""
    given = [(str(b), str(y), float(v)) for b, y, v in user_overrides if str(b) in MANUAL_PSAP_BRANCHES]
    branches = sorted({b for b, _, _ in given}) or MANUAL_PSAP_BRANCHES
    return [(b, y, float(sum(v for b2, y2, v in given if (b2, y2) == (b, y)))) for b in branches for y in sorted(years)]


def assemble_overrides(spark, user_overrides: list, corp: DataFrame | None, years: list[str]) -> DataFrame:
    """OP-R11 / OP-S8: the manual branches plus the bodily-injury SAP + IBNR
    row; long (Branche, Exercice, PSAP)."""
    manual = literal_frame(spark, manual_overrides(user_overrides, years), "Branche string, Exercice string, PSAP double")
    if corp is None:
        return manual
    return manual.unionByName(corp.select(F.lit(BODILY_BRANCH).alias("Branche"), "Exercice", "PSAP"))


def psap_groups(tagged: DataFrame, *keys: str) -> DataFrame:
    """Tagged rows per branch: the rows, and whether the branch has CU or is replaced."""
    return tagged.groupBy(*keys, "Branche", "_merged").agg(gathered(), *[has_kind(k) for k in ("cu", "over", "sap", "ibnr")])


def _replaced() -> Column:
    return F.col("has_over") | (F.col("has_sap") & F.col("has_ibnr"))


def psap_kept() -> Column:
    """Branches that PSAP shows: those replaced, as one row whatever rows they had, and those with CU."""
    return (_replaced() & ~F.col("_merged")) | (~_replaced() & F.col("has_cu"))


def psap_value(year: Column) -> Column:
    """CU less paid (tagged as a negative amount) of a year, or what replaces it."""
    corp = F.when(F.col("has_sap") & F.col("has_ibnr"), year_sum(year, "sap", "ibnr")).otherwise(F.lit(0.0))
    return F.when(_replaced(), year_sum(year, "over") + corp).otherwise(year_sum(year, "cu", "paid"))


def psap_cells(cu: DataFrame, paid: DataFrame, overrides: DataFrame | None, years: list[str]) -> DataFrame:
    """OP-R10: CU (AUTO RC+AR merged) - paid on the dense CU grid (negative
    allowed); override branches replace whole rows.

    One aggregate: CU, paid and override rows are tagged and gathered per
    branch, and the years are unfolded from there.  What was paid for the motor
    branch counts for its merged row as well."""
    own = F.col("Branche") != TOTAL_ROW
    split = F.col("Branche").isin([AUTO_RC, AUTO_AR])
    rows = _tagged(cu.filter(own), "cu", "CU", F.when(split, F.lit(AUTO_BRANCH)).otherwise(F.col("Branche")), split)
    others = _tagged(paid.filter(own), "paid", -F.col("Total_Reglement"))
    if overrides is not None:
        others = others.unionByName(_tagged(overrides, "over", "PSAP"))
    twice = F.when(F.col("Branche") == AUTO_BRANCH, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    rows = rows.unionByName(others.withColumn("_merged", F.explode(twice)))
    groups = psap_groups(rows).filter(psap_kept())
    return _unfolded(groups, years, "Branche", "_merged", PSAP=psap_value)
