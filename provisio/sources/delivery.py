"""Delivered files as tables (OP-S1..S3, S10, S14, OP-F1, F2).

A delivery is a set of CSV files in year slots.  Its files are rows of a
table (path, slot, name, digest, layout, ...), found by Spark itself, so
nothing of them reaches the driver one by one: the driver holds the distinct
layouts (an encoding and a header), whatever the number of files.  All files
are read by one scan per way of quoting, positionally; a row's cells take
their names from its file's layout.
"""

from __future__ import annotations

import csv
import re
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provisio.functions.text import HeaderError, resolve_claims_columns
from provisio.operators.literal import literal_frame
from provisio.session import materialize

FILE_COL = "__file"
SLOT_COL = "__slot"
ENCODINGS = ("UTF-8", "ISO-8859-1")
BOM = "\ufeff"
NEVER_NULL = "\u0001<null>\u0001"  # no text cell is ever read as null
#: the folder a file lies in names its slot, as YYYY or key=YYYY
SLOT_OF_PATH = r"([^/=]+)/[^/]*$"


def norm_path(p: str) -> str:
    """Comparable form of a file path or URI ('file:/a//b' -> '/a/b')."""
    return re.sub(r"/+", "/", p.removeprefix("file:").rstrip("/"))


def norm_path_col(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"^file:", ""), r"/+", "/")


def row_path_col(uri: str = "_metadata.file_path") -> Column:
    """The comparable path of a row's file.  Spark gives it as a URI, with blanks and the like as %20; a plus is a plus."""
    return norm_path_col(F.url_decode(F.replace(F.col(uri), F.lit("+"), F.lit("%2B"))))


def slot_of_path_col(path: str) -> Column:
    """``SLOT_OF_PATH`` as plain text functions, for columns of many rows."""
    return F.substring_index(F.substring_index(F.substring_index(path, "/", -2), "/", 1), "=", -1)


def safe_names(header: list[str]) -> list[str]:
    """Column names of a header, as the CSV reader gives them: a blank one is named by its place, and of names that agree
    but for case each gets its place appended."""
    low = [h.lower() for h in header]
    return [f"_c{i}" if not h else f"{h}{i}" if low.count(h.lower()) > 1 else h for i, h in enumerate(header)]


@dataclass(frozen=True)
class Layout:
    key: str
    utf8: bool
    names: tuple[str, ...]


class Delivery:
    """``listed``: (path, slot, name, size) of every file; ``paths`` and
    ``options`` tell Spark's readers how to find the same files."""

    def __init__(self, spark: SparkSession, paths: list[str], listed: DataFrame, options: dict, sep: str = ",", by_folder: bool = False,
                 facts: DataFrame | None = None):
        self.spark, self.paths, self.listed, self.options, self.sep, self.by_folder = spark, paths, listed, options, sep, by_folder
        if facts is not None:
            self.facts = facts

    @classmethod
    def from_folders(cls, spark: SparkSession, roots: list[str], pattern: str = "*.csv", sep: str = ",") -> Delivery:
        """Every file of the pattern below the roots; its folder names the slot (``2024`` or ``slot=2024``).  A file of no
        bytes is none: Spark's listings pass over it."""
        options = {"pathGlobFilter": pattern, "recursiveFileLookup": "true"}
        found = cls._found(spark, roots, options)
        return cls(spark, roots, found.withColumn("slot", F.regexp_extract("path", SLOT_OF_PATH, 1)), options, sep, by_folder=True)

    @classmethod
    def from_list(cls, spark: SparkSession, files: list[tuple[str, str]], sep: str = ",") -> Delivery:
        """Files that the caller names, as (slot, path)."""
        paths = sorted({p for _, p in files})
        slots = literal_frame(spark, sorted({(norm_path(p), str(y)) for y, p in files}), "path string, slot string")
        listed = slots.join(cls._found(spark, paths, {}).drop("name"), "path", "left")     # Spark lists no file of no bytes
        return cls(spark, paths, listed.withColumn("name", F.regexp_extract("path", r"[^/]*$", 0)).fillna({"size": 0}).withColumn("uri", F.coalesce("uri", "path")), {}, sep)

    @staticmethod
    def _found(spark: SparkSession, paths: list[str], options: dict) -> DataFrame:
        listing = spark.read.format("binaryFile").options(**options).load(paths)      # the content is never asked for
        return listing.select(norm_path_col(F.col("path")).alias("path"), F.col("path").alias("uri"), F.regexp_extract("path", r"[^/]*$", 0).alias("name"),
                              F.col("length").alias("size"), F.col("modificationTime").cast("string").alias("modified"))

    # -- what the files are -------------------------------------------------
    @cached_property
    def facts(self) -> DataFrame:
        """(path, uri, slot, name, size, modified, utf8, header, lines, quoted,
        digest, layout), one row per file, stored.

        One text pass: whether all lines are valid UTF-8, the first line,
        whether a quoted cell spans lines (a line with an odd number of quotes),
        and a digest of the length, the first line and the sum of the lines'
        hashes, plain and weighted by line number.  Files stay splittable: line
        numbers are counted per block and put together per file, so the digest
        doesn't depend on how files were split."""
        blocks = self._blocks()
        before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        placed = blocks.withColumn("weighted", F.col("hp") + (before - F.col("p0")) * F.col("h"))
        read = placed.groupBy("path").agg(
            F.bool_and("utf8").alias("utf8"), F.min_by("first", "start").alias("first"), F.sum("n").alias("lines"), F.sum("h").alias("h"),
            F.sum("weighted").alias("weighted"), F.bool_or("odd").alias("quoted"))
        own = F.when(F.col("first.odd"), F.col("path")).otherwise(F.lit(""))          # a header that spans lines: a layout of its own
        files = self.listed.join(read, "path", "left").select(
            "path", "uri", "slot", "name", "size", "modified", "utf8", F.col("first.v").alias("header"), F.coalesce("lines", F.lit(0)).alias("lines"),
            F.coalesce("quoted", F.lit(False)).alias("quoted"),
            F.md5(F.concat_ws(":", "size", F.coalesce("lines", F.lit(0)), F.hex("first.v"), "h", "weighted")).alias("digest"),
            F.when(F.col("first").isNotNull(), F.md5(F.concat_ws(":", F.col("utf8").cast("string"), F.hex("first.v"), own))).alias("layout"))
        return materialize(files)

    def _blocks(self) -> DataFrame:
        """What ``facts`` needs of every block of a file, by hashing alone."""
        h = F.conv(F.substring(F.md5("value"), 1, 7), 16, 10).cast("bigint")
        odd = lambda c: (F.octet_length(c) - F.octet_length(F.replace(c, F.lit('"'), F.lit("")))) % 2 == 1
        lines = self.spark.read.options(**self.options).text(self.paths).select(
            F.col("_metadata.file_path").alias("at"), F.col("_metadata.file_block_start").alias("start"),
            "value", h.alias("h"), odd(F.col("value")).alias("odd"),
            F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("pos"))
        exact = lambda c: c.cast("decimal(38,0)")
        product = F.col("h") * F.col("pos")           # below 2^61; its halves are summed apart, so that no sum leaves 63 bits
        # The first line is text, which Spark's hash aggregate doesn't hold: with plain aggregates alone it would sort all
        # lines of a task.  A collected set makes it keep an object per block instead, whatever the number of lines.
        return lines.groupBy("at", "start").agg(
            F.collect_set(F.when(F.expr("is_valid_utf8(value)"), F.lit(None)).otherwise(F.lit(True))).alias("broken"),
            F.min_by(F.struct(F.col("value").cast("binary").alias("v"), "odd"), "pos").alias("first"),
            F.count(F.lit(1)).alias("n"), F.sum("h").alias("h"), F.sum(F.shiftright(product, 32)).alias("high"),
            F.sum(product.bitwiseAND(F.lit((1 << 32) - 1))).alias("low"), F.min("pos").alias("p0"), F.bool_or("odd").alias("odd")).select(
            row_path_col("at").alias("path"), "start", (F.size("broken") == 0).alias("utf8"), "first", "n", exact(F.col("h")).alias("h"),
            exact(exact(F.col("high")) * F.lit(1 << 32) + F.col("low")).alias("hp"), exact(F.col("p0")).alias("p0"), "odd")

    def only(self, slots: list[str]) -> Delivery:
        """The files of some slots; Spark is pointed at their folders alone."""
        facts = self.facts.filter(F.col("slot").isin(slots))
        where = F.regexp_extract("uri", r"^(.*)/[^/]*$", 1) if self.by_folder else F.col("uri")
        # what was found is meant as it stands, not as a pattern
        paths = sorted(re.sub(r"([\[\]{}*?\\])", r"\\\1", r["at"]) for r in facts.select(where.alias("at")).distinct().collect())
        return Delivery(self.spark, paths, self.listed.filter(F.col("slot").isin(slots)), self.options if self.by_folder else {}, self.sep, self.by_folder, facts)

    @cached_property
    def _layouts(self) -> tuple[list[Layout], set[bool]]:
        rows = self.facts.filter(F.col("layout").isNotNull()).groupBy("layout").agg(
            F.first("utf8").alias("utf8"), F.first("header").alias("header"), F.min("uri").alias("uri"),
            F.bool_or("quoted").alias("some"), F.bool_and("quoted").alias("every")).collect()
        found = []
        for r in sorted(rows, key=lambda r: (r["utf8"], bytes(r["header"]))):
            text = bytes(r["header"]).decode("utf-8" if r["utf8"] else "latin-1").removeprefix(BOM)
            if text.count('"') % 2:
                whole = read_text_csv(self.spark, [r["uri"]], ENCODINGS[0 if r["utf8"] else 1], self.sep, multi_line=True)
                names = whole.columns
            else:
                names = safe_names(next(csv.reader([text], delimiter=self.sep), []))
            found.append(Layout(r["layout"], r["utf8"], tuple(names)))
        return found, {q for r in rows for q in (r["some"], r["every"])}

    @property
    def layouts(self) -> list[Layout]:
        """The distinct layouts, all that the driver holds of the files."""
        return self._layouts[0]

    def layout_table(self) -> DataFrame:
        """(names, utf8, files, lines) of every layout: what a delivery is made of, whatever the number of its files."""
        names = literal_frame(self.spark, [(x.key, ", ".join(x.names)) for x in self.layouts], "layout string, names string")
        made = self.facts.filter(F.col("layout").isNotNull()).groupBy("layout").agg(
            F.first("utf8").alias("utf8"), F.count(F.lit(1)).alias("files"), F.sum("lines").alias("lines"))
        return made.join(names, "layout").select("names", "utf8", "files", "lines")

    # -- what the files hold -------------------------------------------------
    def cells(self, positions: dict[str, list]) -> DataFrame:
        """(file, slot, cells, pos) of every row: its cells by place, and the
        places that ``positions`` gives for its file's layout.  One scan for
        files without line feeds in cells, split at will, and one for those
        with, each read by one task."""
        layouts, quotings = self._layouts
        width = max((len(x.names) for x in layouts), default=0)
        one = layouts[0] if len(layouts) == 1 else None
        mixed = len({x.utf8 for x in layouts}) > 1
        # bytes survive Latin-1 whatever they are, so one scan serves files of both encodings
        encoding = ENCODINGS[0] if layouts and not mixed and layouts[0].utf8 else ENCODINGS[1]
        schema = ", ".join([*(f"c{i} string" for i in range(width)), "_more string"])  # a column beyond: rows may be shorter than others
        pos = literal_frame(self.spark, [(k, p) for k, p in positions.items()], "layout string, pos array<int>")
        of_file = self.facts.filter(F.col("layout").isNotNull()).join(pos, "layout").select(
            F.col("path").alias(FILE_COL), F.col("slot").alias(SLOT_COL), "utf8", "quoted", "pos")
        out = None
        for quoted in sorted(quotings):
            rows = (self.spark.read.schema(schema).options(**self.options).option("header", True).option("enforceSchema", True)
                    .option("encoding", encoding).option("sep", self.sep).option("quote", '"').option("escape", '"').option("multiLine", quoted)
                    .option("emptyValue", "").option("nullValue", NEVER_NULL).option("mode", "PERMISSIVE").csv(self.paths))
            rows = rows.select(F.array(*[f"c{i}" for i in range(width)]).alias("cells"), row_path_col().alias(FILE_COL))
            if one and self.by_folder and len(quotings) == 1:                          # nothing that a file has to be asked for
                rows = rows.select(FILE_COL, slot_of_path_col(FILE_COL).alias(SLOT_COL), "cells",
                                   F.array(*[F.lit(p).cast("int") for p in positions[one.key]]).alias("pos"))
            else:
                rows = rows.join(of_file.filter(F.col("quoted") == quoted), FILE_COL)
                if mixed:
                    again = F.transform("cells", lambda c: F.encode(c, "ISO-8859-1").cast("string"))
                    rows = rows.withColumn("cells", F.when(F.col("utf8"), again).otherwise(F.col("cells")))
                rows = rows.select(FILE_COL, SLOT_COL, "cells", "pos")
            out = rows if out is None else out.unionByName(rows)
        if out is None:
            return self.spark.createDataFrame([], f"{FILE_COL} string, {SLOT_COL} string, cells array<string>, pos array<int>")
        return out

    def named(self, names: list[str], positions: dict[str, list]) -> DataFrame:
        """All-text rows with these columns, by the places given per layout (null: the layout doesn't have it)."""
        return self.cells(positions).select(*[F.get("cells", F.get("pos", F.lit(i))).alias(n) for i, n in enumerate(names)], FILE_COL, SLOT_COL)

    def rows(self) -> DataFrame:
        """All-text rows under the names of all layouts (names that agree but for case are one, spelled as in the first
        layout); what a file doesn't have is null."""
        names: dict[str, str] = {}
        for x in self.layouts:
            for n in x.names:
                names.setdefault(n.lower(), n)
        places = {x.key: {n.lower(): i for i, n in enumerate(x.names)} for x in self.layouts}
        return self.named(list(names.values()), {k: [p.get(n) for n in names] for k, p in places.items()})

    def claims(self) -> tuple[list[str], DataFrame]:
        """OP-F3: the canonical claims columns of every row, all text, resolved
        once per layout; the first layout that can't be resolved is an error."""
        names = ["Branche", "Total_Reglement", "Cout_Total"]
        places = {}
        for x in self.layouts:
            found = resolve_claims_columns(list(x.names))
            places[x.key] = [x.names.index(found[n]) for n in names]
        return names, self.named(names, places)

    def rejections(self, required: list[str] | None = None) -> DataFrame:
        """OP-S14 as rows: (slot, file, missing, found, available) of every
        file whose header lacks a required column; without ``required``, the
        claims contract.  Columns are listed in the order of the contract, and
        those available as in the file.  A file without a line lacks all."""
        rows = []
        for x in [*self.layouts, Layout("", True, ())]:
            if required is not None:
                missing = [c for c in required if c not in x.names]
                found = [c for c in required if c in x.names]
            else:
                try:
                    resolve_claims_columns(list(x.names))
                    missing, found = [], []
                except HeaderError as e:
                    missing, found = e.missing, [f"{canonical}={header}" for canonical, header in e.found]
            if missing:
                rows.append((x.key, ", ".join(missing), ", ".join(found), ", ".join(x.names)))
        bad = literal_frame(self.spark, rows, "layout string, missing string, found string, available string")
        return self.facts.withColumn("layout", F.coalesce("layout", F.lit(""))).join(bad, "layout").select(
            "slot", F.col("name").alias("file"), "missing", "found", "available")


def fingerprint_of(facts: DataFrame, digest: str = "digest") -> DataFrame:
    """OP-S10: (fingerprint, files): a digest over (slot, name, content) of
    every file.  Each file's digest is summed, so no task holds a list of files
    and their order plays no part."""
    own = F.md5(F.concat_ws(":", "slot", "name", digest))
    half = lambda at: F.coalesce(F.sum(F.conv(F.substring(own, at, 15), 16, 10).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
    told = facts.agg(F.count(F.lit(1)).alias("files"), half(1).alias("a"), half(16).alias("b"))
    return told.select(F.substring(F.md5(F.concat_ws(":", "files", "a", "b")), 1, 16).alias("fingerprint"), "files")


def read_text_csv(spark: SparkSession, paths: list[str], encoding: str = "UTF-8", sep: str = ",", with_file: bool = False,
                  multi_line: bool = False) -> DataFrame:
    """All-string CSV of one layout, header on, empty stays '' (no NA inference), a quote in
    a quoted cell is doubled; with ``with_file`` a normalised source-file
    column is added.  ``multi_line`` is for files whose quoted cells span
    lines: such a file is read by one task."""
    df = (spark.read.option("header", True).option("encoding", encoding).option("sep", sep)
          .option("quote", '"').option("escape", '"').option("multiLine", multi_line)
          .option("inferSchema", False).option("emptyValue", "").option("nullValue", NEVER_NULL)
          .option("mode", "PERMISSIVE").csv(paths))
    # all-text contract: folder partition values (e.g. Exercice=2024) come back typed by discovery
    cols = [F.col(f"`{c}`").cast("string").alias(c) if t != "string" else F.col(f"`{c}`") for c, t in df.dtypes]
    if with_file:
        cols.append(row_path_col().alias(FILE_COL))
    df = df.select(*cols)
    first = df.columns[0] if df.columns else None
    return df.withColumnRenamed(first, first[len(BOM):]) if first and first.startswith(BOM) else df
