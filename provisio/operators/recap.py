"""Per-cell aggregation and the recap matrix (OP-A1..A7, A12, A13, OP-O1..O3, OP-F18).

Internally every measure is a long frame ``(Branche, Exercice, value)`` with
one row per cell.  ``recap_matrix`` turns it into the presented matrix
(years as columns, ``Total`` column, ``TOTAL`` row) with a single
``rollup`` over the cells: one Expand + partial/final aggregate over at most
#branches x #years rows.  Pivot values are explicit, so the column order is
fixed and no discovery job runs inside the pivot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provisio.params import TOTAL_COL, TOTAL_ROW
from provisio.session import materialize_observed

KEYS = ["Branche", "Exercice"]


def cells(df: DataFrame, **measures: Column) -> DataFrame:
    """Sum each measure per (Branche, Exercice).  Partial aggregation runs
    map-side, so a branch holding a third of all rows only ships one partial
    row per task through the shuffle."""
    return df.groupBy(*KEYS).agg(*[F.sum(c).alias(n) for n, c in measures.items()])


def years_of(cells_df: DataFrame) -> list[str]:
    """Sorted distinct years of a (small, per-cell) frame."""
    rows = cells_df.select("Exercice").distinct().collect()
    return sorted(r[0] for r in rows if r[0] is not None)


def stored_with_years(cells_df: DataFrame) -> tuple[DataFrame, list[str]]:
    """The cells as a stored table and their sorted years: one job, the years are
    gathered from the rows while these are written."""
    stored, told = materialize_observed(cells_df, years=F.collect_set("Exercice"))
    return stored, sorted(told["years"])


def recap_matrix(cells_df: DataFrame, value: str, years: list[str] | None = None,
                 branch: str = "Branche", part: str | None = None) -> DataFrame:
    """OP-A2: Branche x sorted years + Total column, TOTAL row last.

    ``cells_df`` holds one row per (branch, Exercice).  Missing cells are 0.
    When ``years`` is not given the cells are stored and their years gathered by
    the same job, so the upstream scan runs once.  Rows of one branch that
    differ in ``part`` stay rows of their own.
    """
    if years is None:
        cells_df, years = stored_with_years(cells_df)
    years = sorted(years)
    dtype = dict(cells_df.dtypes)[value]
    zero = F.lit(0).cast(dtype)
    v, ex = F.col(value), F.col("Exercice")
    per_year = [F.coalesce(F.sum(F.when(ex == y, v)), zero).alias(y) for y in years]
    total = F.coalesce(F.sum(F.when(ex.isin(years), v)), zero).alias(TOTAL_COL)
    keys = [branch, part] if part else [branch]
    out = cells_df.groupingSets([keys, []], *keys).agg(*per_year, total, F.grouping(branch).alias("_is_total"))
    name = F.when(F.col("_is_total") == 1, F.lit(TOTAL_ROW)).otherwise(F.col(branch)).alias(branch)
    out = out.select(name, *years, TOTAL_COL, "_is_total", *keys[1:])
    return out.orderBy("_is_total", F.col(branch).asc_nulls_first(), *keys[1:]).drop("_is_total", *keys[1:])


# ---------------------------------------------------------------------------
# Diagnostics (OP-A3..A7)
# ---------------------------------------------------------------------------
def pe_total(policies: DataFrame) -> DataFrame:
    """OP-A3: total premium, nulls as 0."""
    return policies.agg(F.sum(F.coalesce(F.col("PN_ACC"), F.lit(0.0))).alias("PE_Total"))


def pe_by(policies: DataFrame, *keys: str) -> DataFrame:
    """OP-A4/A5/A7: premium (nulls as 0) and row count by keys, sorted."""
    df = policies.withColumn("Exercice", F.coalesce(F.col("Exercice"), F.lit("NR")))
    return (df.groupBy(*keys)
            .agg(F.sum(F.coalesce(F.col("PN_ACC"), F.lit(0.0))).alias("PE"),
                 F.count(F.lit(1)).alias("Nb_Lignes"))
            .orderBy(*keys))


def pivot_no_totals(cells_df: DataFrame, index: str, value: str, years: list[str]) -> DataFrame:
    """OP-A6 / OP-A12: plain pivot with fill 0, no margins."""
    ex, v = F.col("Exercice"), F.col(value)
    zero = F.lit(0).cast(dict(cells_df.dtypes)[value])
    return cells_df.groupBy(index).agg(*[F.coalesce(F.sum(F.when(ex == y, v)), zero).alias(y) for y in sorted(years)])
