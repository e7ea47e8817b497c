"""Row numbers as a column, so that an order can be read, joined and checked (OP-O1, O2).

Spark keeps no order between rows once they are dealt anew.  ``numbered``
deals the rows over ranges of the order, writes them, counts each range, and
numbers every row by its place in its range and the counts of the ranges
before: no task sees more than a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provisio.params import TOTAL_ROW
from provisio.session import materialize


def branch_order(branch: str = "Branche") -> list[Column]:
    """OP-O1: by branch, nulls first, TOTAL last."""
    return [F.coalesce(F.col(branch) == TOTAL_ROW, F.lit(False)).asc(), F.col(branch).asc_nulls_first()]


def numbered(df: DataFrame, order: list[Column], name: str = "row_no", n_ranges: int | None = None) -> DataFrame:
    """``df`` with the place of each row in the order, from 1."""
    own = [c for c in ("_range", "_within", "_before") if c in df.columns]
    if own:
        raise ValueError(f"reserved column names: {', '.join(own)}")
    dealt = df.repartitionByRange(n_ranges, *order) if n_ranges else df.repartitionByRange(*order)
    dealt = materialize(dealt.withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))          # one row per range
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    placed = dealt.withColumn("_within", within).join(sizes.select("_range", before.alias("_before")), "_range")
    return placed.select(*df.columns, (F.col("_before") + F.col("_within")).cast("bigint").alias(name))
