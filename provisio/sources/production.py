"""Production landing (OP-S1, S3, S4, S9..S14, OP-F5..F9, OP-U1).

Files arrive per year slot (see ``delivery``).  Each is read as all-text (no
type or NA inference), normalised with column expressions, tagged with its slot
year (any source ``Exercice`` is dropped) and unioned by name.  The landed table
is written as zstd Parquet partitioned by ``Exercice`` so later filters on
the year prune partitions.  Header-level decisions (which columns exist,
which look like dates) are schema metadata and run on the driver; every
value-level step runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provisio.functions.amounts import production_amount
from provisio.functions.dates import DATE_MIN_PARSED_SHARE, name_suggests_date, parse_date
from provisio.functions.text import clean_branch, clean_year
from provisio.operators.literal import literal_frame
from provisio.params import PARQUET_COMPRESSION, PARQUET_ROW_GROUP_ROWS
from provisio.session import scratch_dir  # noqa: F401 - part of this module's interface
from provisio.sources.delivery import FILE_COL, NEVER_NULL, SLOT_COL, Delivery, fingerprint_of, read_text_csv  # noqa: F401

AMOUNT_COLUMNS = ["PN_ACC", "Prime_Nette", "Accessoires"]
PRODUCTION_REQUIRED = ["Exercice", "Police", "Client", "Branche", "Categorie", "Intermediaire", "PN_ACC", "Effet", "Echeance"]
#: what every landed table must have, whatever the file (OP-S14)
LANDING_REQUIRED = ["Exercice", "Police", "Branche", "PN_ACC", "Effet", "Echeance"]

def delivery(spark: SparkSession, files: list[tuple[str, str]] | Delivery, sep: str = ",") -> Delivery:
    """Files by (slot, path), or a delivery as it is."""
    return files if isinstance(files, Delivery) else Delivery.from_list(spark, files, sep)


def read_text_csv_detect(spark: SparkSession, paths: list[str], sep: str = ",") -> DataFrame:
    """OP-S3 with fallback: per-file encoding and layout."""
    return Delivery.from_list(spark, [("", p) for p in paths], sep).rows().drop(FILE_COL, SLOT_COL)


# ---------------------------------------------------------------------------
# Normalisation
# ---------------------------------------------------------------------------
def require_columns(df: DataFrame, required: list[str], what: str = "input") -> None:
    """OP-S14: reject an input lacking required columns, naming them."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{what}: colonnes manquantes: {', '.join(missing)}. "
                         f"Colonnes disponibles: {', '.join(df.columns)}")


def date_columns_decision(df: DataFrame) -> DataFrame:
    """OP-F8 decision inputs: per date-named text column, rows that parse and
    their share of all rows (one aggregate over every candidate, one scan)."""
    cands = [c for c, t in df.dtypes if t == "string" and name_suggests_date(c)]
    if not cands:
        return df.sparkSession.createDataFrame([], "column string, parsed long, share double")
    agg = df.agg(*[F.count(parse_date(F.col(f"`{c}`"))).alias(f"c{i}") for i, c in enumerate(cands)],
                 F.count(F.lit(1)).alias("n"))
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("parsed")) for i, c in enumerate(cands)])
    return agg.select(F.explode(pairs).alias("p"), "n").select(
        "p.column", "p.parsed", F.try_divide(F.col("p.parsed").cast("double"), F.col("n").cast("double")).alias("share"))


def coerce_dates(df: DataFrame) -> DataFrame:
    """OP-F8: date-named text columns become DATE when >= 40 % of all rows
    parse (and at least one does); otherwise they stay text.  The decision
    changes the schema, so its one-row-per-column result is read on the
    driver before the projection is built."""
    decided = {r["column"]: r for r in date_columns_decision(df).collect()}
    cols = []
    for c, t in df.dtypes:
        col = F.col(f"`{c}`")
        r = decided.get(c)
        if r is not None and r["parsed"] > 0 and r["share"] >= DATE_MIN_PARSED_SHARE:
            col = parse_date(col)
        cols.append(col.alias(c))
    return df.select(*cols)


def coerce_dates_by_file(df: DataFrame, file_col: str = FILE_COL, skip: tuple[str, ...] = ()) -> DataFrame:
    """OP-F8 decided per source file, as the method does: one aggregate over
    all files (one row per file returns).  A column accepted by every file
    becomes DATE; accepted by none stays text; mixed stays text with ISO
    dates for the files that accepted it (the common type of a date and a
    text column)."""
    cands = [c for c, t in df.dtypes if t == "string" and name_suggests_date(c) and c != file_col and c not in skip]
    if not cands:
        return df                      # no decision pass needed
    n = F.count(F.lit(1))
    parsed = [F.count(parse_date(F.col(f"`{c}`"))) for c in cands]
    has = [F.count(F.col(f"`{c}`")) > 0 for c in cands]         # a file without the column has no say
    stats = df.groupBy(file_col).agg(*[F.when(h, (k > 0) & (k >= DATE_MIN_PARSED_SHARE * n)).alias(f"__ok{i}") for i, (h, k) in enumerate(zip(has, parsed))])
    told = stats.agg(*[f(f"__ok{i}").alias(f"{f.__name__}{i}") for i in range(len(cands)) for f in (F.bool_and, F.bool_or)]).first()
    mixed = [i for i in range(len(cands)) if told[f"bool_or{i}"] and not told[f"bool_and{i}"]]
    if mixed:
        df = df.join(stats.select(file_col, *[f"__ok{i}" for i in mixed]), file_col, "left")
    cols = []
    for c in df.columns:
        col = F.col(f"`{c}`")
        if c.startswith("__ok"):
            continue
        if c in cands:
            i = cands.index(c)
            if told[f"bool_and{i}"]:
                col = parse_date(col)
            elif i in mixed:
                col = F.when(F.col(f"__ok{i}"), F.date_format(parse_date(col), "yyyy-MM-dd")).otherwise(col)
        cols.append(col.alias(c))
    return df.select(*cols)


def sanitize_cells(df: DataFrame, keep: tuple[str, ...] = ("Effet", "Echeance")) -> DataFrame:
    """OP-F9: text cells: null -> '', dates -> ISO text; numbers and the typed
    dates of the contract (``keep``) left as is."""
    out = []
    for c, t in df.dtypes:
        col = F.col(f"`{c}`")
        if c in keep:
            pass
        elif t == "string":
            col = F.coalesce(col, F.lit(""))
        elif t in ("date",):
            col = F.coalesce(F.date_format(col, "yyyy-MM-dd"), F.lit(""))
        elif t.startswith("timestamp"):
            col = F.coalesce(F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(""))
        elif t == "binary":
            col = F.coalesce(F.expr(f"make_valid_utf8(CAST(`{c}` AS STRING))"), F.lit(""))
        out.append(col.alias(c))
    return df.select(*out)


def normalize_production(df: DataFrame) -> DataFrame:
    """OP-F5..F7 + typed dates: strip Branche, clean Exercice, parse amounts
    that are not already double, Effet/Echeance to DATE."""
    types = dict(df.dtypes)
    sel: list[Column] = []
    for c in df.columns:
        col = F.col(f"`{c}`")
        if c == "Branche":
            col = clean_branch(col)
        elif c == "Exercice":
            col = clean_year(col)
        elif c in AMOUNT_COLUMNS and types[c] != "double":
            col = production_amount(col)
        elif c in ("Effet", "Echeance") and types[c] != "date":
            col = parse_date(col) if types[c] == "string" else col.cast("date")
        sel.append(col.alias(c))
    return df.select(*sel)


def derive_pn_acc(df: DataFrame) -> DataFrame:
    """Explicit opt-in: PN_ACC = coalesce(PN_ACC, Prime_Nette + Accessoires)."""
    pn = F.col("Prime_Nette") + F.col("Accessoires")
    if "PN_ACC" in df.columns:
        return df.withColumn("PN_ACC", F.coalesce(F.col("PN_ACC"), pn))
    return df.withColumn("PN_ACC", pn)


WHOLE = [T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType()]


def common_type(types: list[T.DataType]) -> T.DataType:
    """OP-U1: the type that columns of one name are widened to.  Whole numbers
    take the widest of them, whole numbers and fractions are doubles, a truth
    value among numbers is a number, dates and times are times; whatever else
    differs has only its text in common."""
    found = [t for t in dict.fromkeys(types) if not isinstance(t, T.NullType)]
    if len(found) <= 1:
        return found[0] if found else T.StringType()
    numbers = [t for t in found if isinstance(t, T.NumericType)]
    if numbers and all(isinstance(t, (T.NumericType, T.BooleanType)) for t in found):
        return max(numbers, key=WHOLE.index) if all(t in WHOLE for t in numbers) else T.DoubleType()
    if all(isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)) for t in found):
        return T.TimestampType() if T.TimestampType() in found else T.TimestampNTZType()
    if any(isinstance(t, (T.ArrayType, T.MapType, T.StructType, T.BinaryType)) for t in found):
        raise ValueError(f"no common type of {', '.join(t.simpleString() for t in found)}")
    return T.StringType()


def widened(frames: list[DataFrame]) -> list[DataFrame]:
    """The frames with every column that they share (whatever the case of its
    name) brought to its common type, so that a union by name never leaves the
    choice to the engine."""
    seen: dict[str, list[T.DataType]] = {}
    for df in frames:
        for f in df.schema:
            seen.setdefault(f.name.lower(), []).append(f.dataType)
    target = {n: common_type(ts) for n, ts in seen.items()}

    def cast(f: T.StructField) -> Column:
        c, to = F.col(f"`{f.name}`"), target[f.name.lower()]
        if f.dataType == to:
            return c
        if to in WHOLE or isinstance(to, T.DoubleType):
            c = c.cast("int") if isinstance(f.dataType, T.BooleanType) else c
        elif isinstance(to, T.StringType) and isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss").alias(f.name)
        return c.cast(to).alias(f.name)

    return [df.select(*[cast(f) for f in df.schema]) for df in frames]


def union_production(files: list[tuple[str | Column, DataFrame]]) -> DataFrame:
    """OP-S1 / OP-U1: normalise each file, replace Exercice by its slot year,
    widen columns whose types differ, union by name (missing columns null).

    The slot is a year string, or a column expression when one delivery
    carries several slots (e.g. a folder partitioned by slot)."""
    frames = []
    for year, df in files:
        slot = F.lit(str(year)) if isinstance(year, str) else year.cast("string")
        n = normalize_production(df.withColumn("__slot", slot))
        if "Exercice" in n.columns:
            n = n.drop("Exercice")
        frames.append(n.withColumnRenamed("__slot", "Exercice"))
    out = None
    for n in widened(frames):
        out = n if out is None else out.unionByName(n, allowMissingColumns=True)
    return out


def read_production_files(spark: SparkSession, files: list[tuple[str, str]] | Delivery) -> DataFrame:
    """OP-S1 from CSV files, as [(year slot, path)] or a delivery: normalised union.

    One inspection pass (encoding, header, digest; kept with the delivery), one
    scan per way of quoting; the per-file date rule needs an aggregate only for
    date-named columns other than Effet/Echeance, which are parsed anyway.
    The slot year replaces any source Exercice."""
    typed = coerce_dates_by_file(delivery(spark, files).rows(), skip=("Effet", "Echeance"))
    if "Exercice" in typed.columns:
        typed = typed.drop("Exercice")
    return normalize_production(typed).withColumnRenamed(SLOT_COL, "Exercice").drop(FILE_COL)


# ---------------------------------------------------------------------------
# Sink and fingerprint
# ---------------------------------------------------------------------------
def write_production(df: DataFrame, path: str, mode: str = "overwrite", **options) -> None:
    """OP-S4: zstd Parquet partitioned by Exercice, row groups of 100 000 rows
    at most (the writer counts rows, and bytes as always).  Rows are dealt by
    year first, large years over several tasks and small ones together
    (rebalanced at run time), so a year has few, full files."""
    (df.hint("rebalance", "Exercice").write.mode(mode).partitionBy("Exercice")
     .option("compression", PARQUET_COMPRESSION)
     .option("parquet.block.row.count.limit", str(PARQUET_ROW_GROUP_ROWS))
     .options(**options).parquet(path))


def read_landed(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """OP-S9: scan a landed table with ``Exercice`` kept as text (partition
    values such as '2024' would otherwise be inferred as integers)."""
    known = schema or spark.read.parquet(path).schema
    text = T.StructType([T.StructField(f.name, T.StringType(), True) if f.name == "Exercice" else f for f in known])
    return spark.read.schema(text).parquet(path)


def row_groups(spark: SparkSession, path: str) -> DataFrame:
    """(Exercice, file, row_group, rows): the row groups of a landed table, from
    the footers.  An audit: Spark hands a task whole files, one after another."""
    def read(batches):
        import io

        import pyarrow as pa
        import pyarrow.parquet as pq

        for batch in batches:
            for at in range(batch.num_rows):
                part, name, data = (batch.column(i)[at].as_py() for i in range(3))
                meta = pq.ParquetFile(io.BytesIO(data)).metadata
                n = meta.num_row_groups
                yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.string()), pa.array([name] * n, pa.string()), pa.array(range(n), pa.int32()),
                                                  pa.array([meta.row_group(i).num_rows for i in range(n)], pa.int64())], names=["Exercice", "file", "row_group", "rows"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", r"([^/=]+)/[^/]*$", 1), F.regexp_extract("path", r"[^/]*$", 0), "content").mapInArrow(
        read, "Exercice string, file string, row_group int, rows long")


def last_year_landed(landed: DataFrame) -> DataFrame:
    """OP-P1 on the landed table: its last year, told while the query runs; the
    scan of the rows reads that partition alone."""
    last = landed.agg(F.max("Exercice")).scalar()
    return landed.filter(F.col("Exercice") == last)


def fingerprint(spark: SparkSession, files: list[tuple[str, str]] | Delivery, content: bool = True) -> DataFrame:
    """OP-S10: digest over (year slot, file name, content) of every file, as one
    row.  Files are digested and summed on the executors (see ``delivery``).
    With ``content=False`` only file metadata (length, modification time) is
    used and no data is read."""
    given = delivery(spark, files)
    if content:
        return fingerprint_of(given.facts)
    return fingerprint_of(given.listed.withColumn("digest", F.concat_ws(":", "size", "modified")))


def land_production(spark: SparkSession, files: list[tuple[str, str]] | Delivery, root: str, by_content: bool = True,
                    required: list[str] = LANDING_REQUIRED, sanitise: bool = False) -> str:
    """Idempotent landing: the target folder is named by the fingerprint and
    the conversion is skipped when it already holds a landed table (its
    ``_SUCCESS`` marker is written last, so a job lost mid-write re-lands).
    A file set that lacks a required column is refused before anything is
    written (OP-S14); ``sanitise`` turns missing text cells into '' (OP-F9).
    With ``by_content=False`` nothing is read when the table is there already.
    ``landing.land_changes`` replaces only what changed instead."""
    given = delivery(spark, files)
    target = f"{root.rstrip('/')}/production_{fingerprint(spark, given, by_content).first()['fingerprint']}"
    if not exists(spark, target + "/_SUCCESS"):
        # the inspection pass that produced the fingerprint also gives encodings and headers
        rows = read_production_files(spark, given)
        require_columns(rows, required, "production")
        write_production(sanitize_cells(rows) if sanitise else rows, target)
    return target


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


# ---------------------------------------------------------------------------
# Gates and stats
# ---------------------------------------------------------------------------
def missing_years(spark: SparkSession, expected: list[str], present: DataFrame) -> DataFrame:
    """OP-S11: expected year slots without data (left anti join)."""
    exp = literal_frame(spark, [(str(y),) for y in expected], "Exercice string")
    return exp.join(present.select("Exercice").distinct(), "Exercice", "left_anti").orderBy("Exercice")


def dataset_stats(df: DataFrame) -> DataFrame:
    """OP-S12: rows, columns, column names (one row)."""
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows", F.lit(len(df.columns)).cast("bigint").alias("columns"),
        F.lit(",".join(df.columns)).alias("column_names"))


def preview(df: DataFrame, n: int = 10, order: list[str] | None = None) -> DataFrame:
    """OP-S13 / OP-O4: first rows (the limit is the feature), by ``order`` if given."""
    return (df.orderBy(*order) if order else df).limit(n)
