"""Number formatting for displays and reports (OP-F19..F21), no UDF.

``format_number`` rounds half-even on the exact binary value, like Python's
``f'{x:,.2f}'``; ``format_string('%.2f')`` would round half-up.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def fmt_amount(c: Column | str) -> Column:
    """OP-F19: '1 234 567.50'; null -> ''."""
    return F.coalesce(F.replace(F.format_number(_c(c), 2), F.lit(","), F.lit(" ")), F.lit(""))


def fmt_integer(c: Column | str) -> Column:
    """OP-F20: thousands by space, no decimals."""
    return F.coalesce(F.replace(F.format_number(_c(c), 0), F.lit(","), F.lit(" ")), F.lit(""))


def fmt_percent(c: Column | str) -> Column:
    """OP-F20: '72.00%' (no thousands separator); null -> ''."""
    raw = F.replace(F.format_number(_c(c) * 100, 2), F.lit(","), F.lit(""))
    return F.coalesce(F.concat(raw, F.lit("%")), F.lit(""))


def fmt_report(c: Column | str) -> Column:
    """OP-F21: |x|>=1 -> '1 234.50', 0 -> '0,00', else 4 decimals with comma."""
    x = _c(c).cast("double")
    return (
        F.when(x.isNull(), F.lit(""))
        .when(F.abs(x) >= 1, F.replace(F.format_number(x, 2), F.lit(","), F.lit(" ")))
        .when(x == 0, F.lit("0,00"))
        .otherwise(F.replace(F.format_number(x, 4), F.lit("."), F.lit(",")))
    )


NUMERIC_TYPES = ("double", "float", "bigint", "int")


def format_numeric_columns(df, exclude: tuple[str, ...] = ()):
    """OP-F19 over a table: every double/float/bigint/int column (except
    ``exclude``) rendered as '1 234.50', other columns unchanged."""
    return df.select(*[
        fmt_amount(F.col(f"`{c}`")).alias(c) if t in NUMERIC_TYPES and c not in exclude else F.col(f"`{c}`")
        for c, t in df.dtypes])


def taux_display(taux):
    """Rate table as displayed: ratios as percentages, FG share as amount."""
    return taux.select("Branche", fmt_percent("Loss_Ratio").alias("Loss_Ratio"), "PE_Total",
                       fmt_amount("FG_Reparti").alias("FG_Reparti"), fmt_percent("Taux_PREC").alias("Taux_PREC"))
