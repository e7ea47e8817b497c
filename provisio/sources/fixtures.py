"""Adapter views: insurance-shaped inputs derived from the driver's TPC-H-like tables.

The driver tables carry no insurance data, so every registered query reads
these projections.  Their work grows with the tables: ``policies_raw`` is
lineitem joined to orders and part (one policy row per line item),
``claims_raw`` is the line items joined to part, with amounts
rendered as dirty spreadsheet text.

Each view has a DuckDB twin (``*_SQL``) used by the independent oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provisio.params import ReservingParams
from datetime import date

NBSP = "\u00a0"

# Fixed values of the fixture run (parameters chosen for the driver tables)
FIXTURE_MAPPING = {
    "STANDARD": "AUTOMOBILE",
    "PROMO": "SANTE",
    "ECONOMY": "DOMMAGES CORPORELS",
    "MEDIUM": "TRANSPORT",
    "SMALL": "INCENDIE & MULTIRISQUES",
}
FIXTURE_DATE_EVAL = date(2000, 6, 30)
FIXTURE_LOSS_RATIOS = {
    "AUTOMOBILE": 0.70,
    "DOMMAGES CORPORELS": 0.75,
    "INCENDIE & MULTIRISQUES": 0.55,
    "SANTE": 0.80,
    "TRANSPORT": 0.60,
    "VOYAGE": 0.90,
}
FIXTURE_LOSS_RATIOS_SPLIT = {
    "AUTO AR": 0.60,
    "AUTO RC": 0.78,
    "DOMMAGES CORPORELS": 0.74,
    "INCENDIE & MULTIRISQUES": 0.55,
    "LARGE": 0.50,
    "SANTE": 0.80,
    "TRANSPORT": 0.62,
}
# platform share per year; 2001 deliberately absent (calculation layer -> 0/0)
FIXTURE_PLATFORM_SHARES = [
    ("1995", 0.0, 1.0),
    ("1996", 0.10, 0.90),
    ("1997", 0.25, 0.75),
    ("1998", 0.40, 0.60),
    ("1999", 0.65, 0.35),
    ("2000", 0.78, 0.22),
]
FIXTURE_PSAP_OVERRIDES = [("SANTE", "1999", 125000.0), ("SANTE", "2000", 250000.0), ("SANTE", "2003", 1.0)]


def fixture_params() -> ReservingParams:
    return ReservingParams(
        date_eval=FIXTURE_DATE_EVAL,
        mapping=dict(FIXTURE_MAPPING),
        loss_ratios=dict(FIXTURE_LOSS_RATIOS),
        loss_ratios_split=dict(FIXTURE_LOSS_RATIOS_SPLIT),
        platform_shares=list(FIXTURE_PLATFORM_SHARES),
        psap_overrides=list(FIXTURE_PSAP_OVERRIDES),
    )


# Schemas of the driver tables the adapters read (declared so
# no schema-inference job runs per scan; unknown tables are inferred)
TABLE_SCHEMAS = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read
    if name in TABLE_SCHEMAS:
        reader = reader.schema(TABLE_SCHEMAS[name])
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows that lie in fewer splits than the cluster has cores are dealt out by the key of the join that follows, so that
    their work isn't one task's; a table of many splits stays as it lies and is shuffled only if its joins ask for it."""
    splits = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df.repartition(key) if splits < df.sparkSession.sparkContext.defaultParallelism else df


def policies_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Production rows: Police, Branche (observed), Exercice, Effet, Echeance, PN_ACC."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey)
    ln, rf = F.col("l_linenumber"), F.col("l_returnflag")
    effet = F.col("o_orderdate").cast("date")
    echeance = (
        F.when((ln == 7) & (rf == "R"), F.date_sub(effet, 5))
        .when((ln == 6) & (rf == "A"), F.lit(None).cast("date"))
        .otherwise(F.date_add(effet, ((F.col("l_quantity") - 1) * 15).cast("int")))
    )
    return j.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), ln.cast("string")).alias("Police"),
        F.col("p_type").alias("Branche"),
        F.year("o_orderdate").cast("string").alias("Exercice"),
        effet.alias("Effet"),
        echeance.alias("Echeance"),
        F.when((ln == 5) & (rf == "N"), F.lit(None).cast("double"))
        .otherwise(F.col("l_extendedprice")).alias("PN_ACC"),
    )


def _dirty(x: Column, ln: Column) -> Column:
    tx = x.cast("decimal(18,2)").cast("string")
    comma = F.replace(tx, F.lit("."), F.lit(","))
    grouped = F.concat(F.floor(x / 1000).cast("string"), F.lit(NBSP),
                       F.replace(F.substring(tx, -6, 6), F.lit("."), F.lit(",")))
    return (
        F.when(ln == 1, tx)
        .when(ln == 2, comma)
        .when(ln == 3, F.when(x >= 1000, grouped).otherwise(tx))
        .when(ln == 4, F.lit("-"))
        .when(ln == 5, F.lit(""))
        .when(ln == 6, F.concat(F.lit("1,"), comma))
        .otherwise(F.lit("N/A"))
    )


def claims_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All-text claims rows: BRANCHE, Exercice, REGLEMENT, COUT_TOTAL."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate")
    li = spread(li, "l_partkey")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    j = li.join(p, li.l_partkey == p.p_partkey)
    ln = F.col("l_linenumber")
    branche = (
        F.when(ln == 3, F.concat(F.lit(NBSP), F.col("p_type"), F.lit(" ")))
        .when(ln == 2, F.concat(F.lit(" "), F.col("p_type")))
        .otherwise(F.col("p_type"))
    )
    x = F.col("l_extendedprice")
    return j.select(
        branche.alias("BRANCHE"),
        F.year("l_shipdate").cast("string").alias("Exercice"),
        _dirty(x - F.col("l_quantity") * 10, ln).alias("REGLEMENT"),
        _dirty(x, ln).alias("COUT_TOTAL"),
    )


def settlements_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settlements rows: Branche, Exercice, Montant (orders joined to customers)."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("c_mktsegment").alias("Branche"),
        F.year("o_orderdate").cast("string").alias("Exercice"),
        F.col("o_totalprice").alias("Montant"),
    )


# ---------------------------------------------------------------------------
# DuckDB twins (CTE bodies), written independently in SQL
# ---------------------------------------------------------------------------
POLICIES_RAW_SQL = """
SELECT CAST(l.l_orderkey AS VARCHAR) || '-' || CAST(l.l_linenumber AS VARCHAR) AS Police,
       p.p_type AS Branche,
       CAST(year(o.o_orderdate) AS VARCHAR) AS Exercice,
       CAST(o.o_orderdate AS DATE) AS Effet,
       CASE WHEN l.l_linenumber = 7 AND l.l_returnflag = 'R' THEN CAST(CAST(o.o_orderdate AS DATE) - 5 AS DATE)
            WHEN l.l_linenumber = 6 AND l.l_returnflag = 'A' THEN CAST(NULL AS DATE)
            ELSE CAST(CAST(o.o_orderdate AS DATE) + CAST((l.l_quantity - 1) * 15 AS INTEGER) AS DATE) END AS Echeance,
       CASE WHEN l.l_linenumber = 5 AND l.l_returnflag = 'N' THEN CAST(NULL AS DOUBLE)
            ELSE l.l_extendedprice END AS PN_ACC
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey
"""


def _dirty_sql(x: str) -> str:
    tx = f"CAST(CAST({x} AS DECIMAL(18,2)) AS VARCHAR)"
    return f"""CASE l.l_linenumber
        WHEN 1 THEN {tx}
        WHEN 2 THEN replace({tx}, '.', ',')
        WHEN 3 THEN CASE WHEN {x} >= 1000
                         THEN CAST(CAST(floor({x} / 1000) AS BIGINT) AS VARCHAR) || chr(160) || replace(right({tx}, 6), '.', ',')
                         ELSE {tx} END
        WHEN 4 THEN '-'
        WHEN 5 THEN ''
        WHEN 6 THEN '1,' || replace({tx}, '.', ',')
        ELSE 'N/A' END"""


CLAIMS_RAW_SQL = f"""
SELECT CASE WHEN l.l_linenumber = 3 THEN chr(160) || p.p_type || ' '
            WHEN l.l_linenumber = 2 THEN ' ' || p.p_type
            ELSE p.p_type END AS BRANCHE,
       CAST(year(l.l_shipdate) AS VARCHAR) AS Exercice,
       {_dirty_sql('(l.l_extendedprice - l.l_quantity * 10)')} AS REGLEMENT,
       {_dirty_sql('l.l_extendedprice')} AS COUT_TOTAL
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
"""

SETTLEMENTS_RAW_SQL = """
SELECT c.c_mktsegment AS Branche, CAST(year(o.o_orderdate) AS VARCHAR) AS Exercice, o.o_totalprice AS Montant
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
"""
