"""Report dataset (OP-S5, OP-R12): every titled table of the run stacked in
order as long cells, plus comments, written once for humans.

Each cell keeps its number and its report text (OP-F21); section titles and
comments go through the text sanitiser (OP-F22).  The sections of a whole run
come from one table of cells that carries every measure (``matrix_cells``), so
no section plans its joins anew; margins come from grouping sets over them, and
plain tables (the rate table) are unpivoted.  The report is written in its
order; how many files that takes is left to the sort's ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provisio.functions.formatting import fmt_report
from provisio.functions.text import sanitize_text, ustrip
from provisio.operators.literal import literal_frame
from provisio.operators.premium import split_parts
from provisio.operators.reserves import cu_ratio, psap_groups, psap_kept, psap_value
from provisio.params import AUTO_AR, AUTO_BRANCH, AUTO_RC, BODILY_BRANCH, TOTAL_ROW

# Report sections in their natural order
# (key, title, kind, value column(s))
SECTIONS = [
    ("PE", "Production (PE)", "matrix", "PE"),
    ("Taux PREC", "Taux PREC", "table", ["Loss_Ratio", "PE_Total", "FG_Reparti", "Taux_PREC"]),
    ("PREC", "PREC", "matrix", "PREC"),
    ("PA", "PA Globale", "matrix", "PA"),
    ("PA split", "PA Split", "matrix", "PA"),
    ("CU", "CU Detail", "matrix", "CU"),
    ("CU agrege", "CU Auto Agrégé", "matrix", "CU"),
    ("Sinistres nombre", "Sinistres - Nombre", "matrix", "Nombre_Sinistres"),
    ("Sinistres cout", "Sinistres - Cout Total", "matrix", "Cout_Total"),
    ("Reglements", "Sinistres - Règlements", "matrix", "Total_Reglement"),
    ("SAP", "Sinistres - SAP", "matrix", "SAP"),
    ("PSAP", "PSAP Final", "matrix", "PSAP"),
]


NO = {key: no for no, (key, *_) in enumerate(SECTIONS, start=1)}
NO_COL = "section_no"


def _row(section: str, branch, value, kind: str = "", merged=None, exercice="Exercice"):
    """A cell's row of one section."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(F.lit(NO[section]).alias(NO_COL), lit(branch).alias("Branche"), F.col(exercice).alias("Exercice"),
                    lit(merged if merged is not None else False).alias("_merged"), F.lit(kind).alias("_kind"), value.cast("double").alias("v"))


def _only(condition, *rows):
    """The rows as an array, empty unless the condition holds."""
    return F.filter(F.array(*rows), lambda _: F.coalesce(condition, F.lit(False)))


def matrix_cells(rated: DataFrame, claims: DataFrame, overrides: list, years: list[str], platform_shares: list, guarantee_shares: list,
                 loss_ratios_split: dict) -> DataFrame:
    """(section_no, Branche, Exercice, v) of every matrix section.

    Each rated policy cell unfolds into its rows of PE, PREC, PA, split, CU,
    aggregated CU and PSAP, each claims cell into its rows of the claims
    sections and PSAP; the manual overrides are literal rows.  PSAP needs a
    branch's rows together: one aggregate per (section, branch) gathers them."""
    own = F.col("Branche") != TOTAL_ROW
    pa = F.col("PE") - F.col("PREC")
    parts = split_parts(F.col("Branche"), F.col("Exercice"), pa, platform_shares, guarantee_shares)
    if parts is None:
        parts = F.array(F.struct(F.col("Branche").alias("Branche"), pa.alias("v")))

    def of_part(part):
        b, amount = ustrip(part["Branche"]), part["v"]
        ratio = cu_ratio(b, loss_ratios_split)
        motor = b.isin([AUTO_RC, AUTO_AR])
        merged = F.when(motor, F.lit(AUTO_BRANCH)).otherwise(b)
        return F.concat(F.array(_row("PA split", part["Branche"], amount)), _only(
            b != TOTAL_ROW, _row("CU", b, amount * ratio), _row("CU agrege", merged, amount * ratio), _row("PSAP", merged, amount * ratio, "cu", motor)))

    of_policy = F.concat(
        F.array(_row("PE", F.col("Branche"), F.col("PE")), _row("PREC", F.col("Branche"), F.col("PREC"))),
        _only(own, _row("PA", F.col("Branche"), pa)),
        F.flatten(F.transform(F.filter(parts, lambda _: F.coalesce(own, F.lit(False))), of_part)),
        _only(F.col("Branche") == BODILY_BRANCH, _row("PSAP", BODILY_BRANCH, F.col("IBNR"), "ibnr")))
    paid = lambda merged: _row("PSAP", F.col("Branche"), -F.col("Total_Reglement"), "paid", merged)
    claim_sections = [(k, v) for k, _, kind, v in SECTIONS if kind == "matrix" and v in ("Nombre_Sinistres", "Cout_Total", "Total_Reglement", "SAP")]
    of_claims = F.concat(
        F.array(*[_row(k, F.col("Branche"), F.col(v)) for k, v in claim_sections]), _only(own, paid(False)),
        _only(F.col("Branche") == AUTO_BRANCH, paid(True)), _only(F.col("Branche") == BODILY_BRANCH, _row("PSAP", BODILY_BRANCH, F.col("SAP"), "sap")))
    rows = rated.select(F.inline(of_policy)).unionByName(claims.select(F.inline(of_claims)))
    manual = [(NO["PSAP"], b, y, merged, "over", v) for b, y, v in overrides for merged in ([False, True] if b == AUTO_BRANCH else [False])]
    if manual:
        rows = rows.unionByName(literal_frame(rated.sparkSession, manual, f"{NO_COL} int, Branche string, Exercice string, _merged boolean, _kind string, v double"))
    groups = psap_groups(rows, NO_COL)
    psap = F.col(NO_COL) == NO["PSAP"]
    grid = F.transform(F.lit(sorted(years)).cast("array<string>"), lambda y: F.struct(y.alias("Exercice"), psap_value(y).alias("v")))
    plain = F.transform("_rows", lambda r: F.struct(r["Exercice"].alias("Exercice"), r["v"].alias("v")))
    return groups.filter(~psap | psap_kept()).select(NO_COL, "Branche", F.inline(F.when(psap, grid).otherwise(plain)))


def presented_rows(cells: DataFrame) -> DataFrame:
    """One row per line of every matrix: section, branch (TOTAL for the margin)
    and its cells (col_name, value_double) with the Total.  Grouping sets give
    the cells and the margin by year, a second aggregate gathers the lines."""
    s, b, e = NO_COL, "Branche", "Exercice"
    agg = cells.groupingSets([[s, b, e], [s, e]], s, b, e).agg(F.sum("v").alias("v"), F.grouping(b).alias("_margin"))
    agg = agg.withColumn(b, F.when(F.col("_margin") == 1, F.lit(TOTAL_ROW)).otherwise(F.col(b)))
    one = F.struct(F.col(e).alias("col_name"), F.col("v").alias("value_double"))
    total = F.struct(F.lit("Total").alias("col_name"), F.sum("v").alias("value_double"))
    return agg.groupBy(s, "_margin", b).agg(F.array_append(F.collect_list(one), total).alias("_cells")).drop("_margin")


def _table_rows(no: int, value: list[str], df: DataFrame) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias("col_name"), F.col(c).cast("double").alias("value_double")) for c in value])
    return df.select(F.lit(no).alias(NO_COL), "Branche", cells.alias("_cells"))


def render(cells: DataFrame | None, tables: dict[str, DataFrame], comments: dict[str, str] | None = None) -> DataFrame:
    """Long report: (section_no, table_title, row_no, Branche, col_name,
    value_double, value_text) from the cells of the matrix sections and the
    plain tables.  Lines are numbered by branch within their section, nulls
    first and TOTAL last, while each is one row."""
    out = presented_rows(cells) if cells is not None else None
    for no, (key, _, kind, value) in enumerate(SECTIONS, start=1):
        if kind == "table" and key in tables:
            t = _table_rows(no, value, tables[key])
            out = t if out is None else out.unionByName(t)
    last = F.coalesce(F.col("Branche") == TOTAL_ROW, F.lit(False))
    line = F.dense_rank().over(Window.partitionBy(NO_COL).orderBy(last, F.col("Branche").asc_nulls_first()))
    out = out.withColumn("row_no", line.cast("bigint")).select(NO_COL, "row_no", "Branche", F.inline("_cells"))
    titles = F.create_map(*[F.lit(x) for no, (_, title, *_) in enumerate(SECTIONS, start=1) for x in (no, title)])
    out = out.withColumn("table_title", sanitize_text(F.try_element_at(titles, F.col(NO_COL))))
    out = out.withColumn("value_text", fmt_report(F.col("value_double")))
    rows = [(NO[key], SECTIONS[NO[key] - 1][1], text) for key, text in (comments or {}).items() if key in NO]
    if rows:
        c = literal_frame(out.sparkSession, rows, f"{NO_COL} int, table_title string, comment string").select(
            NO_COL, sanitize_text("table_title").alias("table_title"), F.lit(0).cast("bigint").alias("row_no"),
            F.lit(None).cast("string").alias("Branche"), F.lit("comment").alias("col_name"),
            F.lit(None).cast("double").alias("value_double"), sanitize_text("comment").alias("value_text"))
        out = out.unionByName(c)
    return out.select(NO_COL, "table_title", "row_no", "Branche", "col_name", "value_double", "value_text")


def report_cells(frames: dict[str, DataFrame], comments: dict[str, str] | None = None) -> DataFrame:
    """The report of whatever sections the caller has, one frame each."""
    cells = None
    for no, (key, _, kind, value) in enumerate(SECTIONS, start=1):
        if key in frames and kind == "matrix":
            part = frames[key].select(F.lit(no).alias(NO_COL), "Branche", "Exercice", F.col(value).cast("double").alias("v"))
            cells = part if cells is None else cells.unionByName(part)
    return render(cells, frames, {k: c for k, c in (comments or {}).items() if k in NO})


def write_report(report: DataFrame, path: str, fmt: str = "csv") -> None:
    w = report.orderBy("section_no", "row_no", "col_name").write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)
