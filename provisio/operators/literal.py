"""Parameter tables as literal relations.

``createDataFrame`` over a Python list yields an RDD scan of unknown size,
so joins against it are first planned as shuffles.  A literal array of
structs unfolded over a one-row range is planned with a known, tiny size and
joins against it are broadcast statically.  Only driver-held parameters
(bounded by their definition) go through here; they travel as one literal, so
that a plan is built in few calls however many rows there are.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType, _parse_datatype_string


def literal_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    st: StructType = _parse_datatype_string(schema)
    if not rows:
        return spark.createDataFrame([], st)
    data = json.dumps([dict(zip(st.fieldNames(), r, strict=True)) for r in rows], ensure_ascii=False)
    return spark.range(1).select(F.inline(F.from_json(F.lit(data), ArrayType(st), {"mode": "FAILFAST"}))).select(*st.fieldNames())


def ratio_frame(spark: SparkSession, ratios: dict | DataFrame) -> DataFrame:
    """Loss ratios as (Branche, Loss_Ratio), from a dictionary or a table that holds them."""
    if isinstance(ratios, DataFrame):
        return ratios.select("Branche", "Loss_Ratio")
    return literal_frame(spark, [(str(k), float(v)) for k, v in ratios.items()], "Branche string, Loss_Ratio double")
