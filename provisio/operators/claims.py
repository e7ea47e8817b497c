"""Claims side: canonical projection, mapping, aggregation, SAP (OP-F3, OP-S2, OP-A8, OP-A9).

Header resolution runs once per file layout on the driver (it only looks at
column names); the projection, amount parsing and mapping run on the
executors inside one codegen stage, and the only shuffle is the partial
aggregation on (Branche, Exercice).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provisio.functions.amounts import amount_parse_failed, claims_amount
from provisio.functions.text import resolve_claims_columns, ustrip
from provisio.operators.exact import exact_cells
from provisio.operators.mapping import map_branch


def normalize_claims(df: DataFrame, keep: tuple[str, ...] = ("Exercice",)) -> DataFrame:
    """OP-F3: canonical Branche / Total_Reglement / Cout_Total (+ ``keep`` columns
    that exist, e.g. the year slot)."""
    cols = [c for c in df.columns if c not in keep]
    found = resolve_claims_columns(cols)
    extra = [c for c in keep if c in df.columns]
    return df.select(
        ustrip(F.coalesce(F.col(f"`{found['Branche']}`").cast("string"), F.lit(""))).alias("Branche"),
        claims_amount(F.col(f"`{found['Total_Reglement']}`")).alias("Total_Reglement"),
        claims_amount(F.col(f"`{found['Cout_Total']}`")).alias("Cout_Total"),
        *extra,
    )


def map_claims(df: DataFrame, mapping: dict) -> DataFrame:
    """Normalise + map a claims frame that already carries its year slot."""
    n = normalize_claims(df)
    return n.withColumn("Branche", map_branch(F.col("Branche"), mapping))


def claims_agg(claims: DataFrame, exact: bool = False) -> DataFrame:
    """OP-A8: paid, cost and count per (Branche, Exercice); SAP = cost - paid.
    ``exact`` sums amounts as decimals and takes SAP from these."""
    if exact:
        cells = exact_cells(claims, {"paid": "Total_Reglement", "cost": "Cout_Total"})
        return cells.select("Branche", "Exercice", F.col("paid").cast("double").alias("Total_Reglement"), F.col("cost").cast("double").alias("Cout_Total"),
                            F.col("Nb").alias("Nombre_Sinistres"), (F.col("cost") - F.col("paid")).cast("double").alias("SAP"))
    return (claims.groupBy("Branche", "Exercice")
            .agg(F.sum("Total_Reglement").alias("Total_Reglement"),
                 F.sum("Cout_Total").alias("Cout_Total"),
                 F.count(F.lit(1)).cast("bigint").alias("Nombre_Sinistres"))
            .withColumn("SAP", F.col("Cout_Total") - F.col("Total_Reglement")))


def claims_agg_sorted(claims: DataFrame) -> DataFrame:
    """OP-A8 as presented: sorted by (Branche, Exercice)."""
    return claims_agg(claims).orderBy("Branche", "Exercice")


def parse_quality(raw: DataFrame, year_col: str = "Exercice") -> DataFrame:
    """Warning metric for silent amount failures (e.g. the wrong header picked
    by the contains-match): per year slot, non-empty amount cells that fail to
    parse and their share of all rows."""
    found = resolve_claims_columns([c for c in raw.columns if c != year_col])
    reg = amount_parse_failed(F.col(f"`{found['Total_Reglement']}`"))
    cost = amount_parse_failed(F.col(f"`{found['Cout_Total']}`"))
    return (raw.groupBy(year_col)
            .agg(F.count(F.lit(1)).alias("rows"),
                 F.count(F.when(reg, 1)).alias("reglement_failed"),
                 F.count(F.when(cost, 1)).alias("cout_failed"))
            .withColumn("share", (F.col("reglement_failed") + F.col("cout_failed")) / (F.col("rows") * 2)))
