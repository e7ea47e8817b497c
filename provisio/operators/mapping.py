"""Branch mapping and dimension discovery (OP-F10..F14, OP-A10, OP-A11, OP-U5).

The mapping is a parameter (observed label -> target branch) held by the
driver, so its size is known; it is applied as a map literal inside the
projection (no join, no shuffle, stays in whole-stage codegen).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provisio.functions.text import ustrip
from provisio.operators.literal import literal_frame
from provisio.params import NULL_EXERCICE, TARGET_BRANCHES


def map_literal(mapping: dict) -> Column:
    items = sorted((str(k), v) for k, v in mapping.items())
    return F.create_map(*[F.lit(x) for kv in items for x in kv])


def map_branch(c: Column, mapping: dict) -> Column:
    """OP-F10: dictionary lookup, unmatched keep their value, null stays null."""
    if not mapping:
        return c
    return F.coalesce(F.try_element_at(map_literal(mapping), c), c)


def fill_defaults(df: DataFrame) -> DataFrame:
    """OP-F14: Exercice null -> 'NR', PN_ACC null -> 0."""
    return df.na.fill({"Exercice": NULL_EXERCICE, "PN_ACC": 0.0})


def map_policies(df: DataFrame, mapping: dict, target: str = "Branche") -> DataFrame:
    """Defaults + mapping of the production rows (the shared first step)."""
    df = fill_defaults(df)
    return df.withColumn(target, map_branch(F.col("Branche").cast("string"), mapping))


def distinct_branches(df: DataFrame) -> DataFrame:
    """OP-A10: non-null distinct branches, sorted."""
    return df.select("Branche").distinct().filter(F.col("Branche").isNotNull()).orderBy("Branche")


def distinct_exercices(df: DataFrame) -> DataFrame:
    """OP-A11: distinct years with null -> 'NR', sorted as strings."""
    return (df.select(F.coalesce(F.col("Exercice"), F.lit(NULL_EXERCICE)).alias("Exercice"))
            .distinct().orderBy("Exercice"))


def last_exercice(df: DataFrame) -> DataFrame:
    """OP-A11: lexicographic max of the years ('NR' sorts after digits)."""
    return df.agg(F.max(F.coalesce(F.col("Exercice"), F.lit(NULL_EXERCICE))).alias("last_exercice"))


def default_mapping(observed: DataFrame, targets: list[str] = TARGET_BRANCHES) -> DataFrame:
    """OP-F12: case-insensitive trimmed equality with a target, else the first
    target; ``matched`` exposes the silent default."""
    lookup = F.create_map(*[F.lit(x) for t in targets for x in (t.upper(), t)])
    hit = F.try_element_at(lookup, F.upper(ustrip(F.col("Branche_obs"))))
    return (observed.select(F.col("Branche").alias("Branche_obs")).distinct()
            .filter(F.col("Branche_obs").isNotNull())
            .select("Branche_obs",
                    F.coalesce(hit, F.lit(targets[0])).alias("Branche"),
                    hit.isNotNull().alias("matched")))


def mapping_staleness(observed: DataFrame, saved_mapping: dict) -> DataFrame:
    """OP-F13 / OP-U5: keys observed but not saved and saved but not observed.

    Empty result = the saved mapping is still valid."""
    spark = observed.sparkSession
    obs = observed.select(F.col("Branche").alias("key")).filter(F.col("key").isNotNull()).distinct()
    saved = literal_frame(spark, [(str(k),) for k in saved_mapping], "key string")
    new = obs.join(saved, "key", "left_anti").withColumn("status", F.lit("observed_not_mapped"))
    gone = saved.join(obs, "key", "left_anti").withColumn("status", F.lit("mapped_not_observed"))
    return new.unionByName(gone)
