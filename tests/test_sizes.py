"""Deliveries whose tasks keep few bytes and whose rows are worked out once, however many rows there are."""

import tempfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from provisio.functions.dates import DATE_FORMATS, parse_date
from provisio.plans import catalog
from provisio.session import unsorted_folders
from provisio.sources import fixtures as fx
from provisio.sources.delivery import SLOT_OF_PATH, Delivery, slot_of_path_col

TYPES = ["STANDARD", "PROMO", "ECONOMY", "MEDIUM", "SMALL"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def tables(spark):
    root = tempfile.mkdtemp(prefix="provisio-test-")
    rows = {
        "part": [(p, f"part {p}", "B", TYPES[p % 5], 3, 1.0) for p in range(10)],
        "orders": [(o, o, "O", 1.0, datetime(1994 + o % 8, 1 + o % 12, 5), "1-URGENT") for o in range(80)],
        "lineitem": [(o, (o + n) % 10, 1, n, 2.0 + n, 900.0 + 31 * o + n, 0.0, 0.0, "NAR"[o % 3], "O", datetime(1994 + o % 8, 3, 4)) for o in range(80) for n in range(1, 8)],
    }
    for name, values in rows.items():
        spark.createDataFrame(values, fx.TABLE_SCHEMAS[name]).write.parquet(f"{root}/{name}.parquet")
    return root


def test_files_are_inspected_without_sorting_their_lines(spark):
    root = tempfile.mkdtemp(prefix="provisio-test-")
    spark.range(50).select(F.col("id").cast("string").alias("A"), (F.col("id") % 2).alias("slot")).write.mode("overwrite").partitionBy("slot").option("header", True).csv(root)
    given = Delivery.from_folders(spark, [root])
    made = plan(given._blocks())
    assert "ObjectHashAggregate" in made and "SortAggregate" not in made and "Sort " not in made
    assert given.facts.filter("utf8 AND CAST(header AS STRING) = 'A'").agg(F.sum(F.col("lines") - 1)).first()[0] == 50


def test_rows_are_written_by_folder_without_a_sort(spark):
    root, key = tempfile.mkdtemp(prefix="provisio-test-"), "spark.sql.maxConcurrentOutputFileWriters"
    spark.sql(f"CREATE TABLE provisio_folders (a BIGINT, slot STRING) USING csv PARTITIONED BY (slot) LOCATION '{root}/t'")
    try:
        explained = lambda: spark.sql("EXPLAIN INSERT OVERWRITE provisio_folders SELECT id, CAST(id % 3 AS STRING) FROM range(9)").first()[0]
        before = spark.conf.get(key)
        assert "Sort " in explained()
        with unsorted_folders(spark):
            assert "Sort " not in explained()
        assert spark.conf.get(key) == before
    finally:
        spark.sql("DROP TABLE provisio_folders")
    with unsorted_folders(spark, 2):                                    # more folders than files kept open
        spark.range(0, 100, 1, 1).select("id", (F.col("id") % 7).alias("slot")).write.partitionBy("slot").option("header", True).csv(f"{root}/in")
    assert spark.read.option("header", True).csv(f"{root}/in").agg(F.countDistinct("id"), F.count("id")).first()[:] == (100, 100)


@pytest.mark.parametrize("name, kept_out", [("fingerprint_sensitivity", ["Join", "Exchange"]), ("landing_rejections", ["hashpartitioning(slot"]),
                                            ("claims_rejections", ["hashpartitioning(slot"])])
def test_no_version_is_joined_or_dealt_anew(spark, tables, monkeypatch, name, kept_out):
    plans, write = [], catalog._write_slots
    monkeypatch.setattr(catalog, "_write_slots", lambda df, *a, **k: (plans.append(plan(df)), write(df, *a, **k))[1])
    rows = catalog.QUERIES[name](spark, tables).collect()
    assert len(plans) in (3, 4) and not [w for w in kept_out for p in plans if w in p]
    if name == "fingerprint_sensitivity":
        assert [tuple(r) for r in rows] == [(True,) * 6 + (560,)]
    else:
        assert {r.slot: r.rows for r in rows} == {str(y): 70 for y in (1994, 1995, 1996, 1999, 2000, 2001)}


@pytest.mark.parametrize("name", ["csv_encoding_fallback", "claims_header_variants", "delivery_layouts", "landing_incremental"])
def test_slots_are_written_by_the_one_helper(spark, tables, monkeypatch, name):
    told, write = [], catalog._write_slots
    monkeypatch.setattr(catalog, "_write_slots", lambda *a, **k: (told.append(a[1]), write(*a, **k))[1])
    rows = catalog.QUERIES[name](spark, tables).collect()
    assert told
    if name == "delivery_layouts":
        assert sum(r.files for r in rows) == 8 and sum(r.lines for r in rows) == 560 + 8
    else:
        assert sum(r["rows"] if name == "landing_incremental" else r.Nombre_Sinistres for r in rows) == 560


def test_dates_are_tried_by_their_shape_and_read_alike(spark):
    n = ["1", "01", "12", "31", "0", "007", "+3", "-3", "13", " 1", "1 ", "x", "", "2024", "02024", "+12024", "-2024", "99"]
    texts = [a + s + b + s + c for a in n for b in ("1", "02", "12", "13", "+2", "", "002") for c in n for s in "/-."]
    days = ["2024-02-29", "2023-02-29", "2024-2-3", "+12024-01-02", "02024-01-02", "-2024-01-02", "2024-01-02"]
    texts += [d + t for d in days for t in ("", " 10:20:30", "T10:20:30", "t10:20:30", " 1:2:3", "T1:02:03", " 24:00:00", "  10:20:30", " 10:20", "T", " ", "\n", "x", "T10:20:30Z", " 10:20:30.5", "T\n")]
    texts += ["1/2/2024\n", "\n1/2/2024", "1/2/2024 10:20:30", "١/٢/٢٠٢٤", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    plain = F.coalesce(*[F.to_date(F.try_to_timestamp("s", F.lit(f))) for f in DATE_FORMATS])
    both = df.select("s", parse_date("s").alias("a"), plain.alias("b"))
    assert [tuple(r) for r in both.filter(~F.col("a").eqNullSafe(F.col("b"))).collect()] == []
    assert both.filter("a IS NOT NULL").count() > 300
    # the text is worked out once, whatever the number of layouts
    assert df.select(parse_date("s").alias("d"))._jdf.queryExecution().optimizedPlan().toString().splitlines()[0].count("s#") == 1


def test_slot_of_a_path_without_a_pattern(spark):
    paths = ["/a/slot=1997/x.csv", "/a/2024/x.csv", "/a/slot=/x.csv", "/x.csv", "/a/k=v=w/x.csv", "/a/b=c/2023/y=1.csv", "/a/ 19 97/x", "//x"]
    got = spark.createDataFrame([(p,) for p in paths], "p string").select(slot_of_path_col("p"), F.regexp_extract("p", SLOT_OF_PATH, 1)).collect()
    assert all(a == b for a, b in got), got
