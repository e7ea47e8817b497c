"""Premium side: PE, PREC rate, PREC, earned premium PA and the motor split
(OP-R1..R5, OP-P1, OP-P2, OP-J1..J3, OP-F15..F17).

Scale design: one pass over the policy rows.  The PREC of a row is
``PE * remaining/total * rate(branch)`` and the rate depends on the branch
only, so the per-cell PREC is ``rate(branch) * sum(PE * remaining/total)``.
``policy_cells`` therefore aggregates, in a single partial+final hash
aggregate on (Branche, Exercice), every per-row quantity the method needs
(PE, unexpired weight, IBNR earned premium and charge, row count).  The rate
table (one row per loss-ratio branch, i.e. bounded by the parameter) is only
joined to these cells.  ``prec_lines`` keeps the row-level view for audits.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provisio.functions.dates import days_between
from provisio.operators.exact import exact_sum
from provisio.operators.literal import literal_frame, ratio_frame
from provisio.operators.mapping import map_literal
from provisio.params import (
    AUTO_AR, AUTO_BRANCH, AUTO_RC, FG_LOADING, IBNR_LF_BASE, IBNR_LF_EXPIRED, IBNR_LF_SLOPE,
    IBNR_LOSS_RATIO, NULL_EXERCICE, PLATFORM_SHARE_MISSING_CALC, PLATFORM_SHARE_OTHER_YEAR,
    PLATFORM_SHARE_DEFAULTS, TAUX_PREC_MIN, TOTAL_ROW,
)


def _d(c: str) -> Column:
    return F.col(c).cast("date")


def prec_terms(date_eval: date) -> dict[str, Column]:
    """Row-level PREC terms (OP-R2)."""
    ev, eff, ech = F.lit(date_eval), _d("Effet"), _d("Echeance")
    total = days_between(ech, eff)
    remaining = (F.when(ev > ech, F.lit(0))
                 .when(eff > ev, days_between(ech, eff))
                 .otherwise(days_between(ech, ev)))
    return {"duree_totale": total, "duree_restante": remaining}


def unexpired_weight(pe: Column, total: Column, remaining: Column) -> Column:
    """PE * remaining/total, 0 for zero-length contracts, null counts as 0."""
    return F.when(total == 0, F.lit(0.0)).otherwise(pe * F.try_divide(remaining, total))


def policy_cells(policies: DataFrame, date_eval: date, ibnr_loss_ratio: float = IBNR_LOSS_RATIO, exact: bool = False) -> DataFrame:
    """Single aggregation of mapped policy rows into per-cell measures:
    PE, PREC_base (= sum PE*remaining/total), Prime_Acquise, Charge_Theorique,
    IBNR, Nb (rows).  ``exact`` sums the premiums as decimals, so that PE is
    the same whatever the partitioning.

    The per-row terms are staged in projections (durations, then maturity,
    then the weighted amounts) so each is computed once per row inside the
    same codegen stage; the aggregate only sums columns."""
    ev = F.lit(date_eval)
    k = ["Branche", "Exercice"]
    t = policies.select(*k, F.col("PN_ACC").alias("pe"), _d("Effet").alias("eff"), _d("Echeance").alias("ech"))
    t = t.select(*k, "pe", (ev >= F.col("ech")).alias("expired"),
                 days_between("ech", "eff").alias("total"),
                 F.when(ev > F.col("ech"), F.lit(0)).when(F.col("eff") > ev, days_between("ech", "eff"))
                 .otherwise(days_between("ech", ev)).alias("remaining"),
                 days_between(ev, "eff").cast("double").alias("t_raw"))
    d = F.col("total").cast("double")
    maturity = F.when(d > 0, F.try_divide(F.greatest(F.lit(0.0), F.least(d, F.col("t_raw"))), d)).otherwise(F.lit(0.0))
    t = t.select(*k, "pe", "expired", "total", "remaining", maturity.alias("M"))
    lag = F.when(F.col("expired"), F.lit(IBNR_LF_EXPIRED)).otherwise(F.lit(IBNR_LF_BASE) - F.lit(IBNR_LF_SLOPE) * F.col("M"))
    t = t.select(*k, "pe", unexpired_weight(F.col("pe"), F.col("total"), F.col("remaining")).alias("unexpired"),
                 (F.col("pe") * F.col("M")).alias("earned"), lag.alias("LF"))
    t = t.select(*k, "pe", "unexpired", "earned", (F.col("earned") * F.lit(float(ibnr_loss_ratio))).alias("charge"), "LF")
    return t.groupBy(*k).agg(
        (exact_sum("pe").cast("double") if exact else F.sum("pe")).alias("PE"),
        F.sum("unexpired").alias("PREC_base"),
        F.sum("earned").alias("Prime_Acquise"),
        F.sum("charge").alias("Charge_Theorique"),
        F.sum(F.col("charge") * F.col("LF")).alias("IBNR"),
        F.count(F.lit(1)).alias("Nb"),
    )


def last_year_filter(df: DataFrame, last_exercice: str | None) -> DataFrame:
    """OP-P1: rows of the last underwriting year (string comparison)."""
    ex = F.coalesce(F.col("Exercice"), F.lit(NULL_EXERCICE))
    if last_exercice is None:
        last = df.agg(F.max(ex)).scalar()
        return df.filter(ex == last)
    return df.filter(ex == F.lit(last_exercice))


def taux_prec(pe_cells: DataFrame, loss_ratios: dict | DataFrame, frais_generaux: float,
              last_exercice: str | None = None, taux_min: float = TAUX_PREC_MIN) -> DataFrame:
    """OP-R1: per loss-ratio branch: Loss_Ratio, PE_Total (last year),
    FG_Reparti = PE_Total / total_pe * FG, Taux_PREC.

    ``total_pe`` covers every branch of the last year (also those without a
    ratio) and is a scalar subquery over the per-cell frame."""
    lr = ratio_frame(pe_cells.sparkSession, loss_ratios)
    pe_last = (last_year_filter(pe_cells, last_exercice)
               .groupBy("Branche").agg(F.sum("PE").alias("PE_Total")))
    total_pe = _total_of_year(pe_cells, last_exercice)
    out = lr.join(pe_last, "Branche", "left").na.fill({"PE_Total": 0.0})
    fg, rate = _rate(F.col("Loss_Ratio"), F.col("PE_Total"), total_pe, frais_generaux, taux_min)
    return out.select("Branche", "Loss_Ratio", "PE_Total", fg.alias("FG_Reparti"), rate.alias("Taux_PREC")).orderBy("Branche")


def _total_of_year(pe_cells: DataFrame, exercice: str | None) -> Column:
    return last_year_filter(pe_cells, exercice).agg(F.sum("PE")).scalar()


def _rate(ratio: Column, pe: Column, total_pe: Column, frais_generaux: float, taux_min: float) -> tuple[Column, Column]:
    """The branch's share of the general expenses and its rate."""
    fg = F.try_divide(pe, total_pe) * F.lit(float(frais_generaux))
    loaded = ratio + F.try_divide(F.lit(FG_LOADING) * fg, pe)
    floor = F.lit(float(taux_min))
    return fg, F.when(pe == 0, F.greatest(floor, ratio)).otherwise(F.greatest(floor, loaded))


def rated_cells(cells_df: DataFrame, loss_ratios: dict | DataFrame, frais_generaux: float, last_exercice: str | None,
                taux_min: float = TAUX_PREC_MIN) -> DataFrame:
    """The cells with the rate of their branch (``Taux_PREC``) and their ``PREC``.

    A branch's cells are gathered into one row (its years), where the rate is
    taken from the premium of the last year, and unfolded again: the rate table
    is never joined back to the cells.  Ratios given as a dictionary are looked
    up in a map literal, a table of ratios is joined to the branch rows."""
    own = [c for c in cells_df.columns if c != "Branche"]
    in_last = F.coalesce(F.col("Exercice"), F.lit(NULL_EXERCICE)) == F.lit(last_exercice)
    branches = cells_df.groupBy("Branche").agg(
        F.coalesce(F.sum(F.when(in_last, F.col("PE"))), F.lit(0.0)).alias("_pe"), F.collect_list(F.struct(*own)).alias("_cells"))
    if isinstance(loss_ratios, DataFrame):
        branches = branches.join(loss_ratios.select("Branche", F.col("Loss_Ratio").alias("_ratio")), "Branche", "left")
    else:
        ratio = F.lit(None).cast("double")
        if loss_ratios:
            ratio = F.try_element_at(map_literal({k: float(v) for k, v in loss_ratios.items()}), F.col("Branche"))
        branches = branches.withColumn("_ratio", ratio)
    _, rate = _rate(F.col("_ratio"), F.col("_pe"), _total_of_year(cells_df, last_exercice), frais_generaux, taux_min)
    rate = F.when(F.col("_ratio").isNotNull(), rate).otherwise(F.lit(float(taux_min)))
    out = branches.select("Branche", rate.alias("Taux_PREC"), F.inline("_cells"))
    return out.withColumn("PREC", F.coalesce(F.col("PREC_base") * F.col("Taux_PREC"), F.lit(0.0)))


def prec_cells(cells_df: DataFrame, taux: DataFrame, taux_min: float = TAUX_PREC_MIN) -> DataFrame:
    """OP-R2 per cell: PREC = rate(branch, default floor) * PREC_base; the
    rate of the last year applies to every year."""
    j = cells_df.join(taux.select("Branche", "Taux_PREC"), "Branche", "left")
    prec = F.col("PREC_base") * F.coalesce(F.col("Taux_PREC"), F.lit(float(taux_min)))
    return j.select("Branche", "Exercice", "PE", F.coalesce(prec, F.lit(0.0)).alias("PREC"))


def prec_lines(policies: DataFrame, taux: DataFrame, date_eval: date,
               taux_min: float = TAUX_PREC_MIN) -> DataFrame:
    """OP-R2 per policy row (audit view): durations, rate and PREC."""
    terms = prec_terms(date_eval)
    j = policies.join(taux.select("Branche", "Taux_PREC"), "Branche", "left")
    rate = F.coalesce(F.col("Taux_PREC"), F.lit(float(taux_min)))
    prec = F.coalesce(unexpired_weight(F.col("PN_ACC"), terms["duree_totale"], terms["duree_restante"]) * rate,
                      F.lit(0.0))
    return j.select("Police", "Branche", "Exercice", "Effet", "Echeance", F.col("PN_ACC").alias("PE"),
                    terms["duree_totale"].cast("bigint").alias("duree_totale"),
                    terms["duree_restante"].cast("bigint").alias("duree_restante"),
                    rate.alias("Taux_PREC"), prec.alias("PREC"))


def date_anomalies(policies: DataFrame) -> DataFrame:
    """OP-P2: policies whose start is after their end (reported, not removed)."""
    return policies.filter(_d("Effet") > _d("Echeance")).select("Police", "Branche", "Effet", "Echeance")


def pa_cells(prec_cells_df: DataFrame) -> DataFrame:
    """OP-R3: PA = PE - PREC per cell; rows with Branche 'TOTAL' or null are
    dropped as the matrix subtraction does."""
    return (prec_cells_df.filter(F.col("Branche") != TOTAL_ROW)
            .select("Branche", "Exercice", (F.col("PE") - F.col("PREC")).alias("PA")))


def null_branch_drop(prec_cells_df: DataFrame) -> DataFrame:
    """Diagnostic for the PA step: PE, PREC and PA of rows without a branch
    (or literally named 'TOTAL'), which the matrix subtraction drops, so
    that sum(PE) - sum(PREC) - sum(PA) is explained."""
    dropped = F.col("Branche").isNull() | (F.col("Branche") == TOTAL_ROW)
    return prec_cells_df.agg(
        F.coalesce(F.sum(F.when(dropped, F.col("PE"))), F.lit(0.0)).alias("PE_dropped"),
        F.coalesce(F.sum(F.when(dropped, F.col("PREC"))), F.lit(0.0)).alias("PREC_dropped"),
        F.coalesce(F.sum(F.when(dropped, F.col("PE") - F.col("PREC"))), F.lit(0.0)).alias("PA_dropped"))


def split_params(years_df: DataFrame, platform_shares: list = PLATFORM_SHARE_DEFAULTS) -> DataFrame:
    """OP-R5: platform shares for every data year; years without a given
    share get the parameter-layer default (0 / 1)."""
    spark = years_df.sparkSession
    given = literal_frame(spark, [(str(y), float(p), float(h)) for y, p, h in platform_shares],
                          "Annee string, Plateforme double, Hors double")
    extra = (years_df.select(F.col("Exercice").alias("Annee")).distinct()
             .join(given, "Annee", "left_anti")
             .select("Annee", F.lit(PLATFORM_SHARE_OTHER_YEAR[0]).alias("Plateforme"),
                     F.lit(PLATFORM_SHARE_OTHER_YEAR[1]).alias("Hors")))
    return given.unionByName(extra).orderBy("Annee")


def pa_split(pa: DataFrame, platform_shares: list, guarantee_shares: list, value: str = "PA") -> DataFrame:
    """OP-R4: replace AUTOMOBILE by AUTO RC and AUTO AR.

    coeff(type, year) = plat(year) * type.plat + off(year) * type.off; a year
    without shares gets 0/0 (its amount disappears); coefficients are not
    normalised.  Without both guarantee types the input is returned."""
    parts = split_parts(F.col("Branche"), F.col("Exercice"), F.col(value), platform_shares, guarantee_shares)
    if parts is None:
        return pa
    return pa.filter(F.col("Branche").isNotNull()).select("Exercice", F.explode(parts).alias("_p")).select(
        F.col("_p.Branche").alias("Branche"), "Exercice", F.col("_p.v").alias(value))


def split_parts(branch: Column, exercice: Column, amount: Column, platform_shares: list, guarantee_shares: list) -> Column | None:
    """The rows of the split that a cell becomes, as an array of (Branche, v): two for the motor branch, itself for any
    other.  None without both guarantee types."""
    types: dict = {}
    for t, p, h in guarantee_shares:
        types.setdefault(t, (float(p), float(h)))
    if AUTO_RC not in types or AUTO_AR not in types:
        return None
    shares = {str(y): (float(p), float(h)) for y, p, h in platform_shares}

    def share(i: int) -> Column:
        missing = F.lit(PLATFORM_SHARE_MISSING_CALC[i])
        return F.coalesce(F.try_element_at(map_literal({y: s[i] for y, s in shares.items()}), exercice), missing) if shares else missing

    plat, off = share(0), share(1)
    pair = [F.struct(F.lit(t).alias("Branche"), (amount * (plat * F.lit(types[t][0]) + off * F.lit(types[t][1]))).alias("v")) for t in (AUTO_RC, AUTO_AR)]
    return F.when(branch == AUTO_BRANCH, F.array(*pair)).otherwise(F.array(F.struct(branch.alias("Branche"), amount.alias("v"))))
