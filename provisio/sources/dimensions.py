"""Dimension and parameter files: loss ratios (OP-S6, OP-F11), settlements
(OP-S7, OP-A12), PSAP overrides (OP-S8), claims files (OP-S2).

Parameter tables stay DataFrames, whatever their size, and are joined.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provisio.functions.amounts import number
from provisio.functions.text import ustrip
from provisio.operators.literal import literal_frame, ratio_frame
from provisio.params import DEFAULT_LOSS_RATIO, MANUAL_PSAP_BRANCHES
from provisio.operators.claims import normalize_claims
from provisio.operators.mapping import map_branch
from provisio.session import materialize
from provisio.sources.delivery import SLOT_COL, Delivery, read_text_csv


def loss_ratio_frame(df: DataFrame) -> DataFrame | None:
    """OP-S6 core: requires Branche and Loss_Ratio; Branche stripped; the
    last duplicate (file order) wins; None when the contract is not met."""
    if not {"Branche", "Loss_Ratio"}.issubset(df.columns):
        return None
    ordered = df.select(ustrip(F.col("Branche").cast("string")).alias("Branche"),
                        number(F.col("Loss_Ratio")).alias("Loss_Ratio"),
                        F.monotonically_increasing_id().alias("_pos"))
    # a cell that is no number counts even when a later row replaces it
    return ordered.groupBy("Branche").agg(F.max_by("Loss_Ratio", "_pos").alias("last"), F.bool_and(F.col("Loss_Ratio").isNotNull()).alias("good")).select(
        "Branche", F.when(F.col("good"), F.col("last")).alias("Loss_Ratio"))


def read_loss_ratios(spark: SparkSession, path: str, branches: DataFrame) -> DataFrame:
    """OP-S6: (Branche, Loss_Ratio) for every branch.  One bad file or cell
    gives all branches the default: a missing column, a ratio that is no
    number, or a file that can't be read."""
    try:
        frame = loss_ratio_frame(read_text_csv(spark, [path]))
    except AnalysisException:          # no such file, or nothing in it
        frame = None
    if frame is None:
        return resolve_loss_ratios(branches, {})
    frame = materialize(frame)
    if not frame.filter(F.col("Loss_Ratio").isNull()).isEmpty():
        return resolve_loss_ratios(branches, {})
    return resolve_loss_ratios(branches, frame)


def resolve_loss_ratios(branches: DataFrame, loss_ratios: dict | DataFrame) -> DataFrame:
    """OP-F11: every branch gets its ratio or 0.65; extra ratio branches kept."""
    lr = ratio_frame(branches.sparkSession, loss_ratios)
    b = branches.select("Branche").filter(F.col("Branche").isNotNull()).distinct()
    return (b.join(lr, "Branche", "full_outer")
            .select("Branche", F.coalesce("Loss_Ratio", F.lit(DEFAULT_LOSS_RATIO)).alias("Loss_Ratio"))
            .orderBy("Branche"))


def settlements_cells(df: DataFrame) -> DataFrame:
    """OP-S7 long form: Montant summed per (Branche, Exercice)."""
    return df.groupBy("Branche", "Exercice").agg(F.sum(F.col("Montant").cast("double")).alias("Montant"))


def read_settlements(spark: SparkSession, path: str) -> DataFrame:
    return settlements_cells(read_text_csv(spark, [path]))


def overrides_long(df: DataFrame, years: list[str]) -> DataFrame:
    """OP-S8: keep the manual branches, year headers as text (or '2024.0'
    style numbers), missing year -> 0; long (Branche, Exercice, PSAP)."""
    if "Branche" not in df.columns:
        raise ValueError("Colonnes manquantes dans le fichier: Branche")
    year_cols = {}
    for c in df.columns:
        key = c[:-2] if c.endswith(".0") else c
        if key in years:
            year_cols[key] = c
    kept = df.filter(F.col("Branche").isin(MANUAL_PSAP_BRANCHES))
    vals = [F.struct(F.lit(y).alias("Exercice"),
                     (number(F.col(f"`{year_cols[y]}`")) if y in year_cols else F.lit(0.0))
                     .alias("PSAP")) for y in sorted(years)]
    return kept.select("Branche", F.explode(F.array(*vals)).alias("v")).select(
        "Branche", "v.Exercice", F.coalesce("v.PSAP", F.lit(0.0)).alias("PSAP"))


def read_overrides(spark: SparkSession, path: str, years: list[str]) -> DataFrame:
    """OP-S8 from a file: its manual branches, or a zero per manual branch and
    year when the file can't be read, lacks ``Branche``, has no manual branch
    or holds a cell that is no number."""
    zeros = literal_frame(spark, [(b, y, 0.0) for b in MANUAL_PSAP_BRANCHES for y in sorted(years)], "Branche string, Exercice string, PSAP double")
    try:
        raw = read_text_csv(spark, [path])
        found = overrides_long(raw, years)
    except (AnalysisException, ValueError):
        return zeros
    cells = [F.col(f"`{c}`") for c in raw.columns if (c[:-2] if c.endswith(".0") else c) in years]
    bad = [F.coalesce(F.length(c) > 0, F.lit(False)) & number(c).isNull() for c in cells]
    told = raw.filter(F.col("Branche").isin(MANUAL_PSAP_BRANCHES)).agg(F.count(F.lit(1)).alias("n"), *[F.bool_or(b).alias(f"b{i}") for i, b in enumerate(bad)]).first()
    return zeros if not told["n"] or any(told[f"b{i}"] for i in range(len(bad))) else found


def read_claims_files(spark: SparkSession, files: list[tuple[str, str]] | Delivery, mapping: dict) -> DataFrame:
    """OP-S2 from files, as [(year slot, path)] or a delivery: text read with
    encoding fallback, headers resolved once per layout, one projection for all."""
    if isinstance(files, list) and not files:
        raise ValueError("claims: at least one file is needed")
    given = files if isinstance(files, Delivery) else Delivery.from_list(spark, files)
    if not given.layouts:
        raise ValueError("claims: at least one file is needed")
    names, rows = given.claims()
    n = normalize_claims(rows.select(*names, SLOT_COL), keep=(SLOT_COL,))
    return n.withColumn("Branche", map_branch(F.col("Branche"), mapping)).withColumnRenamed(SLOT_COL, "Exercice")
