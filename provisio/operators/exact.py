"""Sums that don't depend on the order of the rows (OP-A1, OP-A8).

A sum of doubles changes in its last digits with the partitioning.  Amounts
have a fixed number of decimals, so they are summed as decimals: whatever the
partitions, retries and merges, the total is the same bit for bit.  Amounts
are rounded half up to ``scale`` decimals, once, row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 4
#: 24 digits before the point per row, and room for 10^10 rows of the largest amount in the sum
PRECISION = 28


def exact_sum(c: Column | str, scale: int = SCALE) -> Column:
    """The sum as a decimal; null amounts count as nothing, and so do infinities and nan, which have no decimals."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.sum(c.try_cast(f"decimal({PRECISION},{scale})")), F.lit(0).cast(f"decimal({PRECISION + 10},{scale})"))


def exact_cells(rows: DataFrame, amounts: dict[str, str], keys: tuple[str, ...] = ("Branche", "Exercice")) -> DataFrame:
    """Per cell the exact sum of each amount (name -> column) and the number of
    rows.  Partial sums are taken before the shuffle, as of doubles."""
    return rows.groupBy(*keys).agg(*[exact_sum(F.col(c)).alias(n) for n, c in amounts.items()], F.count(F.lit(1)).alias("Nb"))
