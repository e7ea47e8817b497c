"""Landing only what changed (OP-S10).

A landed table keeps a manifest beside its partitions: a row per delivered
file (slot, name, digest) and the table's schema.  A new delivery is compared
with it, and only the slots in which a file is new, gone or different are read
and replaced, each as a whole, by dynamic partition overwrite.  Every landing
writes a manifest of its own, last of all, so a job lost midway leaves the old
one and the next run lands the same slots again.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provisio.operators.literal import literal_frame
from provisio.sources.delivery import Delivery
from provisio.sources.production import (
    LANDING_REQUIRED, delivery, read_landed, read_production_files, require_columns, sanitize_cells, write_production,
)

MANIFEST = "_manifest"   # Spark's readers pass over folders that begin with an underscore
FILE_KEY = ["slot", "name", "digest"]


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, target: str) -> list[str]:
    """Finished manifests, oldest first (their ``_SUCCESS`` is written last)."""
    pattern, fs = _fs(spark, f"{target}/{MANIFEST}/v=*/_SUCCESS")
    return sorted(str(x.getPath().getParent()) for x in fs.globStatus(pattern) or [])


def manifest(spark: SparkSession, target: str) -> DataFrame | None:
    """(slot, name, digest, schema) of the landed files, None before the first landing."""
    done = _versions(spark, target)
    return spark.read.schema("slot string, name string, digest string, schema string").parquet(done[-1]) if done else None


def landed_schema(spark: SparkSession, target: str) -> T.StructType | None:
    known = manifest(spark, target)
    row = known.agg(F.max("schema")).first() if known is not None else None
    return T.StructType.fromJson(json.loads(row[0])) if row and row[0] else None


def read_changes_landed(spark: SparkSession, target: str) -> DataFrame:
    """OP-S9 of a table landed by ``land_changes``: its schema is the manifest's;
    a column that came later is null in the partitions landed before."""
    return read_landed(spark, target, landed_schema(spark, target))


def changed_slots(now: DataFrame, before: DataFrame | None) -> dict[str, str]:
    """Slots in which a file is new, gone or different: 'landed', or 'removed'
    for one without any file now.  As many rows as there are slots come back."""
    mine = now.select(*FILE_KEY)
    if before is None:
        differ = mine.select("slot").distinct()
    else:
        old = before.select(*FILE_KEY)
        differ = mine.exceptAll(old).unionByName(old.exceptAll(mine)).select("slot").distinct()
    here = mine.groupBy("slot").agg(F.lit("landed").alias("status"))
    rows = differ.join(here, "slot", "left").select("slot", F.coalesce("status", F.lit("removed")).alias("status")).collect()
    return {r["slot"]: r["status"] for r in rows}


def _merged(old: T.StructType | None, new: T.StructType) -> T.StructType | None:
    """The old schema and the columns that are new, None if a column has changed its type."""
    known = {f.name.lower(): f for f in old or []}
    if any(f.name.lower() in known and known[f.name.lower()].dataType != f.dataType for f in new):
        return None
    return T.StructType([*(old or []), *(f for f in new if f.name.lower() not in known)])


def land_changes(spark: SparkSession, files: list[tuple[str, str]] | Delivery, target: str, required: list[str] = LANDING_REQUIRED,
                 sanitise: bool = False) -> DataFrame:
    """Bring the table at ``target`` up to the delivery; (slot, status) of every
    slot that was touched: 'landed', or 'removed' where nothing is left.

    A column whose type the new files change (a date column that now holds
    text) concerns all partitions, so everything is landed again."""
    given = delivery(spark, files)
    before = manifest(spark, target)
    touched = changed_slots(given.facts, before)
    if touched:
        _replace(spark, given, target, touched, before, required, sanitise)
    return literal_frame(spark, sorted(touched.items()), "slot string, status string")


def _replace(spark: SparkSession, given: Delivery, target: str, touched: dict[str, str], before: DataFrame | None, required: list[str], sanitise: bool) -> None:
    old = landed_schema(spark, target) if before is not None else None
    slots = sorted(s for s, status in touched.items() if status == "landed")
    schema = old
    if slots:
        rows = read_production_files(spark, given.only(slots) if before is not None else given)
        schema = _merged(old, _typed(rows, sanitise).schema)
        if schema is None:
            others = [r["slot"] for r in given.facts.filter("lines > 1").select("slot").distinct().collect()]
            touched.update({s: "landed" for s in others if s not in touched})
            rows = read_production_files(spark, given)
            schema = _typed(rows, sanitise).schema
        require_columns(rows, required, "production")
        seen = Observation()
        write_production(_typed(rows, sanitise).observe(seen, F.collect_set("Exercice").alias("slots")), target, partitionOverwriteMode="dynamic")
        written = set(seen.get["slots"])
        for s in touched:
            if touched[s] == "landed" and s not in written:
                touched[s] = "removed"                    # its files hold no row
    for s, status in touched.items():
        if status == "removed":
            folder = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString("Exercice", s)
            path, fs = _fs(spark, f"{target}/{folder}")
            fs.delete(path, True)
    version = len(_versions(spark, target)) + 1
    (given.facts.select(*FILE_KEY, F.lit(schema.json() if schema is not None else None).cast("string").alias("schema"))
     .write.mode("overwrite").parquet(f"{target}/{MANIFEST}/v={version:012d}"))


def _typed(rows: DataFrame, sanitise: bool) -> DataFrame:
    return sanitize_cells(rows) if sanitise else rows
