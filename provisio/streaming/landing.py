"""Claims files landed incrementally (OP-S2 delivered as a file stream).

New CSV files under ``<source>/Exercice=YYYY/`` are read as all-text rows
(the slot year comes from the folder), normalised and mapped with the same
expressions as the batch path, and appended to a Parquet table partitioned
by Exercice.  The stream's checkpoint lives in the session's reliable
checkpoint directory, so a restarted job resumes without re-landing files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from provisio.operators.claims import map_claims
from provisio.session import scratch_dir
from provisio.sources.delivery import NEVER_NULL


def claims_stream(spark: SparkSession, source: str, header: list[str], mapping: dict, multi_line: bool = False) -> DataFrame:
    # the slot year is a partition folder: declared in the schema, filled from the path;
    # CSV columns are positional under a user schema, so a source year keeps its place
    cols = [f"_source_{h}" if h == "Exercice" else h for h in header]
    schema = ", ".join([f"`{h}` string" for h in cols] + ["Exercice string"])
    raw = (spark.readStream.schema(schema).option("header", True).option("emptyValue", "")
           .option("quote", '"').option("escape", '"').option("multiLine", multi_line)
           .option("nullValue", NEVER_NULL).csv(source))
    return map_claims(raw.drop(*[c for c in cols if c.startswith("_source_")]), mapping)


def land_claims(spark: SparkSession, source: str, header: list[str], mapping: dict, target: str,
                checkpoint: str | None = None, available_now: bool = True, multi_line: bool = False) -> StreamingQuery:
    stream = claims_stream(spark, source, header, mapping, multi_line)
    writer = (stream.writeStream.format("parquet").option("path", target)
              .option("checkpointLocation", checkpoint or scratch_dir(spark, "claims-stream"))
              .partitionBy("Exercice").outputMode("append"))
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def production_stream(spark: SparkSession, source: str, header: list[str], multi_line: bool = False) -> DataFrame:
    """Production files under ``<source>/Exercice=YYYY/`` as a stream of
    normalised policy rows (slot year from the folder, source year dropped)."""
    from provisio.sources.production import normalize_production

    # CSV columns are positional under a user schema: keep the file order and
    # park a source year column under another name; the slot year is the folder
    cols = [f"_source_{h}" if h == "Exercice" else h for h in header]
    schema = ", ".join([f"`{h}` string" for h in cols] + ["Exercice string"])
    raw = (spark.readStream.schema(schema).option("header", True).option("emptyValue", "")
           .option("quote", '"').option("escape", '"').option("multiLine", multi_line)
           .option("nullValue", NEVER_NULL).csv(source))
    return normalize_production(raw.drop(*[c for c in cols if c.startswith("_source_")]))


def land_production_stream(spark: SparkSession, source: str, header: list[str], target: str,
                           checkpoint: str | None = None, available_now: bool = True, multi_line: bool = False) -> StreamingQuery:
    """OP-S1 + OP-S4 incrementally: new yearly files appended to the landed
    Parquet table partitioned by Exercice."""
    writer = (production_stream(spark, source, header, multi_line).writeStream.format("parquet").option("path", target)
              .option("checkpointLocation", checkpoint or scratch_dir(spark, "production-stream"))
              .partitionBy("Exercice").outputMode("append"))
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def maintain_claims_cells(spark: SparkSession, source: str, header: list[str], mapping: dict, target: str,
                          checkpoint: str | None = None, available_now: bool = True, multi_line: bool = False) -> StreamingQuery:
    """OP-A8 maintained incrementally: paid, cost and count per (Branche,
    Exercice) kept in streaming state (partial aggregation per micro-batch,
    state keyed by cell).  After each batch the per-cell table (branches x
    years) is written to a folder of its own under ``target``; readers take
    the newest finished one (``read_cells``), so they never see a table that
    is being replaced."""
    from pyspark.sql import functions as F

    cells = (claims_stream(spark, source, header, mapping, multi_line)
             .groupBy("Branche", "Exercice")
             .agg(F.sum("Total_Reglement").alias("Total_Reglement"), F.sum("Cout_Total").alias("Cout_Total"),
                  F.count(F.lit(1)).alias("Nombre_Sinistres")))

    def publish(batch: DataFrame, epoch: int) -> None:
        (batch.withColumn("SAP", F.col("Cout_Total") - F.col("Total_Reglement"))
         .write.mode("overwrite").parquet(f"{target}/epoch={epoch:012d}"))

    writer = (cells.writeStream.outputMode("complete").foreachBatch(publish)
              .option("checkpointLocation", checkpoint or scratch_dir(spark, "claims-cells-stream")))
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def read_cells(spark: SparkSession, target: str) -> DataFrame:
    """The per-cell table of the newest finished epoch (its ``_SUCCESS`` marker is written last)."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(target)
    fs = root.getFileSystem(conf)
    done = sorted(str(x.getPath().getParent()) for x in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{target}/epoch=*/_SUCCESS")))
    if not done:
        raise FileNotFoundError(f"no finished epoch under {target}")
    return spark.read.parquet(done[-1])
