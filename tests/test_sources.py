"""File sources and sinks: landing, encodings, fingerprint, dimension files, contracts, streaming."""

import os
import tempfile
import time

import pytest
from pyspark.sql import functions as F

from provisio.sources import dimensions as dim
from provisio.sources import landing
from provisio.sources import production as prod
from provisio.sources.delivery import Delivery, safe_names


@pytest.fixture()
def tmp(spark):
    return tempfile.mkdtemp(prefix="provisio-test-")


def _write(path, text, encoding="utf-8", bom=False):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    data = text.encode(encoding)
    if bom:
        data = b"\xef\xbb\xbf" + data
    with open(path, "wb") as f:
        f.write(data)
    return path


PROD_2023 = ("Exercice,Police,Branche,PN_ACC,Effet,Echeance\n"
             "1999,P1, Auto ,1 000,50,01/01/2023,31/12/2023\n")
PROD_2024 = ("Police,Branche,PN_ACC,Effet,Echeance,Client\n"
             "P2,Santé,\"2 500,00\",2024-03-01,2025-02-28,Zoé\n"
             "P3,Santé,abc,2024-04-01,2025-03-31,Léa\n")


def test_production_landing_roundtrip(spark, tmp):
    f1 = _write(f"{tmp}/in/2023/a.csv", PROD_2023.replace("1 000,50", "\"1 000,50\""), "latin-1")
    f2 = _write(f"{tmp}/in/2024/a.csv", PROD_2024, bom=True)
    df = prod.read_production_files(spark, [("2023", f1), ("2024", f2)])
    rows = {r["Police"]: r for r in df.collect()}
    assert rows["P1"]["Exercice"] == "2023" and rows["P1"]["Branche"] == "Auto"
    assert rows["P1"]["PN_ACC"] == 1000.5 and rows["P1"]["Client"] is None
    assert str(rows["P1"]["Effet"]) == "2023-01-01" and str(rows["P1"]["Echeance"]) == "2023-12-31"
    assert rows["P2"]["Branche"] == "Santé" and rows["P2"]["Client"] == "Zoé"   # UTF-8 with BOM
    assert rows["P2"]["PN_ACC"] == 2500.0 and rows["P3"]["PN_ACC"] is None
    target = prod.land_production(spark, [("2023", f1), ("2024", f2)], f"{tmp}/out")
    assert sorted(r["Exercice"] for r in prod.read_landed(spark, target).select("Exercice").distinct().collect()) == ["2023", "2024"]
    stamp = os.path.getmtime(f"{target}/_SUCCESS")
    time.sleep(1)
    assert prod.land_production(spark, [("2023", f1), ("2024", f2)], f"{tmp}/out") == target   # idempotent
    assert os.path.getmtime(f"{target}/_SUCCESS") == stamp


def test_encoding_detection(spark, tmp):
    a = _write(f"{tmp}/enc/a.csv", "Branche\nCafé\n", "latin-1")
    b = _write(f"{tmp}/enc/b.csv", "Branche\nCafé\n", "utf-8")
    utf8 = {r.path: r.utf8 for r in Delivery.from_list(spark, [("", a), ("", b)]).facts.collect()}
    assert utf8 == {a: False, b: True}
    got = sorted(r[0] for r in prod.read_text_csv_detect(spark, [a, b]).collect())
    assert got == ["Café", "Café"]


def test_fingerprint_sensitivity(spark, tmp):
    a = _write(f"{tmp}/fp/2023/x.csv", "a,b\n1,2\n")
    b = _write(f"{tmp}/fp/2024/x.csv", "a,b\n1,2\n")      # same name and bytes, other slot
    fp = lambda files: prod.fingerprint(spark, files).first()
    base = fp([("2023", a), ("2024", b)])
    assert base["files"] == 2
    assert fp([("2023", a), ("2024", b)])["fingerprint"] == base["fingerprint"]
    assert fp([("2024", a), ("2023", b)])["fingerprint"] == base["fingerprint"]    # same (year, name, bytes) set
    assert fp([("2023", a), ("2025", b)])["fingerprint"] != base["fingerprint"]    # year matters
    meta = prod.fingerprint(spark, [("2023", a), ("2024", b)], content=False).first()
    assert meta["files"] == 2
    _write(b, "a,b\n1,3\n")
    assert fp([("2023", a), ("2024", b)])["fingerprint"] != base["fingerprint"]    # bytes matter


def test_contracts_and_gates(spark):
    df = spark.createDataFrame([("2023", "P1")], "Exercice string, Police string")
    with pytest.raises(ValueError, match="colonnes manquantes: Branche"):
        prod.require_columns(df, ["Exercice", "Police", "Branche"], "production")
    miss = [r[0] for r in prod.missing_years(spark, ["2022", "2023", "2024"], df).collect()]
    assert miss == ["2022", "2024"]
    st = prod.dataset_stats(df).first()
    assert (st["rows"], st["columns"], st["column_names"]) == (1, 2, "Exercice,Police")


def test_date_coercion_rule(spark):
    rows = [("01/02/2024", "01/02/2024", "x")] + [("bad", "03/04/2024", "y")] * 2
    df = spark.createDataFrame(rows, "`Date effet` string, `Date d'échéance` string, Police string")
    out = prod.coerce_dates(df)
    types = dict(out.dtypes)
    assert types["Date effet"] == "string"          # 1/3 parse < 40 %
    assert types["Date d'échéance"] == "date"       # 3/3 parse
    assert types["Police"] == "string"
    assert str(out.first()["Date d'échéance"]) == "2024-02-01"


def test_loss_ratio_file(spark, tmp):
    f = _write(f"{tmp}/lr.csv", "Branche,Loss_Ratio\n AUTO ,0.5\nSANTE,0.7\nAUTO,0.6\n")
    names = spark.createDataFrame([("AUTO",), ("SANTE",), ("VOYAGE",)], "Branche string")
    read = lambda path: {r.Branche: r.Loss_Ratio for r in dim.read_loss_ratios(spark, path, names).collect()}
    assert read(f) == {"AUTO": 0.6, "SANTE": 0.7, "VOYAGE": 0.65}
    default = {"AUTO": 0.65, "SANTE": 0.65, "VOYAGE": 0.65}
    assert read(_write(f"{tmp}/java.csv", "Branche,Loss_Ratio\nAUTO,0.7d\nSANTE,0.7\n")) == default       # Java's number, not the method's
    assert read(_write(f"{tmp}/odd.csv", "Branche,Loss_Ratio\nAUTO, 1_0.5 \nSANTE,+inf\n")) == {"AUTO": 10.5, "SANTE": float("inf"), "VOYAGE": 0.65}
    assert read(_write(f"{tmp}/bad.csv", "Branch,LR\nAUTO,0.5\n")) == default
    assert read(_write(f"{tmp}/cell.csv", "Branche,Loss_Ratio\nAUTO,x\nAUTO,0.5\nSANTE,0.7\n")) == default   # one bad cell
    assert read(f"{tmp}/nowhere.csv") == default
    res = {r.Branche: r.Loss_Ratio for r in dim.resolve_loss_ratios(
        spark.createDataFrame([("AUTO",), ("X",)], "Branche string"), {"AUTO": 0.5, "EXTRA": 0.9}).collect()}
    assert res == {"AUTO": 0.5, "X": 0.65, "EXTRA": 0.9}


def test_override_and_settlement_files(spark, tmp):
    o = _write(f"{tmp}/ov.csv", "Branche,2024,2025.0\nSANTE,10,20\nAUTO,1,1\n")
    got = {(r.Branche, r.Exercice): r.PSAP for r in dim.overrides_long(dim.read_text_csv(spark, [o]), ["2024", "2025", "2026"]).collect()}
    assert got == {("SANTE", "2024"): 10.0, ("SANTE", "2025"): 20.0, ("SANTE", "2026"): 0.0}
    s = _write(f"{tmp}/st.csv", "Branche,Exercice,Montant\nA,2024,1.5\nA,2024,2\nB,2025,3\n")
    cells = {(r.Branche, r.Exercice): r.Montant for r in dim.read_settlements(spark, s).collect()}
    assert cells == {("A", "2024"): 3.5, ("B", "2025"): 3.0}


def test_override_file_falls_back_to_zeros(spark, tmp):
    zeros = {("SANTE", "2024"): 0.0, ("SANTE", "2025"): 0.0}
    for name, text in (("a", "B,2024\nSANTE,1\n"), ("b", "Branche,2024\nAUTO,1\n"), ("c", "Branche,2024\nSANTE,x\n"), ("d", "Branche,2024\nSANTE,1f\n")):
        path = _write(f"{tmp}/{name}.csv", text)
        assert {(r.Branche, r.Exercice): r.PSAP for r in dim.read_overrides(spark, path, ["2024", "2025"]).collect()} == zeros
    assert dim.read_overrides(spark, f"{tmp}/none.csv", ["2024"]).count() == 1


def test_quoted_cells(spark, tmp):
    a = _write(f"{tmp}/q/a.csv", 'Branche,Montant\n"AUTO ""VIP"" x",10\n"two\nlines",20\n"a, b",30\n')
    b = _write(f"{tmp}/q/b.csv", 'Branche,Montant\nplain,40\n"say ""hi""",50\n')
    c = _write(f"{tmp}/q/c.csv", '"Bran\nche",Montant\nx,60\n')
    got = {(r.Branche, r.Montant) for r in prod.read_text_csv_detect(spark, [a, b]).collect()}
    assert got == {('AUTO "VIP" x', "10"), ("two\nlines", "20"), ("a, b", "30"), ("plain", "40"), ('say "hi"', "50")}
    assert prod.read_text_csv_detect(spark, [c]).columns == ["Bran\nche", "Montant"]
    assert {r.name: r.quoted for r in Delivery.from_list(spark, [("", a), ("", b)]).facts.collect()} == {"a.csv": True, "b.csv": False}


def test_fingerprint_tells_header_from_body_and_line_order(spark, tmp):
    of = lambda path: Delivery.from_list(spark, [("", path)]).facts.first().digest
    digest = lambda text: of(_write(f"{tmp}/d/{abs(hash(text))}.csv", text))
    base, swapped, moved = (digest(t) for t in ("A,B\n1,2\n", "1,2\nA,B\n", "A,B\n1,2\n3,4\n"))
    other = digest("A,B\n3,4\n1,2\n")
    assert len({base, swapped, moved, other}) == 4
    # block sizes make no difference
    path = _write(f"{tmp}/d/long.csv", "A,B\n" + "".join(f"{i},{i * 7}\n" for i in range(4000)))
    whole = of(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        assert of(path) == whole
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_landing_refuses_a_file_without_required_columns(spark, tmp):
    f = _write(f"{tmp}/in/2024/a.csv", "Police,Branche,PN_ACC,Echeance\nA,X,1,2024-12-31\n")
    with pytest.raises(ValueError, match="Effet"):
        prod.land_production(spark, [("2024", f)], f"{tmp}/out")
    with pytest.raises(ValueError, match="at least one file"):
        dim.read_claims_files(spark, [], {})


def test_plan_does_not_grow_with_files(spark, tmp):
    size = []
    for n in (2, 12):
        files = [(str(2000 + i), _write(f"{tmp}/g{n}/{i}/a.csv", f"Police,Branche,PN_ACC,Effet,Echeance\nP{i},X,1,2024-01-01,2024-12-31\n")) for i in range(n)]
        df = prod.read_production_files(spark, files)
        assert {r.Exercice for r in df.collect()} == {y for y, _ in files}
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        size.append(len(plan.replace("\n", "")))
    assert abs(size[0] - size[1]) < 200


def test_claims_files_and_stream(spark, tmp):
    from provisio.operators.claims import claims_agg
    from provisio.streaming.landing import land_claims
    a = _write(f"{tmp}/claims/Exercice=2023/a.csv", "BRANCHE,GARANTIE,REGLEMENT,COUT_TOTAL\nAUTO,RC,\"1 000,5\",2000\nAUTO,Vol,-,500\n")
    b = _write(f"{tmp}/claims/Exercice=2024/b.csv", "BRANCHE,GARANTIE,REGLEMENT,COUT_TOTAL\nSANTÉ,x,10,n/a\n", "latin-1")
    batch = claims_agg(dim.read_claims_files(spark, [("2023", a), ("2024", b)], {"AUTO": "AUTOMOBILE"}))
    got = {(r.Branche, r.Exercice): (r.Total_Reglement, r.Cout_Total, r.Nombre_Sinistres, r.SAP) for r in batch.collect()}
    assert got == {("AUTOMOBILE", "2023"): (1000.5, 2500.0, 2, 1499.5), ("SANTÉ", "2024"): (10.0, 0.0, 1, -10.0)}
    q = land_claims(spark, f"{tmp}/claims", ["BRANCHE", "GARANTIE", "REGLEMENT", "COUT_TOTAL"],
                    {"AUTO": "AUTOMOBILE"}, f"{tmp}/landed", checkpoint=f"{tmp}/ckpt")
    q.awaitTermination(120)
    landed = prod.read_landed(spark, f"{tmp}/landed")
    per_year = {r.Exercice: (r.n, r.cost) for r in landed.groupBy("Exercice").agg(
        F.count(F.lit(1)).alias("n"), F.sum("Cout_Total").alias("cost")).collect()}
    assert per_year == {"2023": (2, 2500.0), "2024": (1, 0.0)}


def test_mixed_layouts_in_one_slot(spark, tmp):
    a = _write(f"{tmp}/mix/2024/a.csv", "Police,Branche,PN_ACC,Effet,Echeance\nA,X,10,01/01/2024,31/12/2024\n")
    b = _write(f"{tmp}/mix/2024/b.csv", "Echeance,Effet,PN_ACC,Branche,Police\n31/12/2024,01/01/2024,20,Y,B\n")
    c = _write(f"{tmp}/mix/2023/c.csv", "Police,Branche,PN_ACC,Effet,Echeance\nC,X,5,01/01/2023,31/12/2023\n")
    assert len(Delivery.from_list(spark, [("2024", a), ("2024", b), ("2023", c)]).layouts) == 2   # a and c share a layout across slots
    rows = {r.Police: r for r in prod.read_production_files(spark, [("2024", a), ("2024", b), ("2023", c)]).collect()}
    assert (rows["A"].PN_ACC, rows["B"].PN_ACC, rows["C"].PN_ACC) == (10.0, 20.0, 5.0)
    assert (rows["A"].Branche, rows["B"].Branche) == ("X", "Y")
    assert (rows["A"].Exercice, rows["B"].Exercice, rows["C"].Exercice) == ("2024", "2024", "2023")
    assert str(rows["B"].Echeance) == "2024-12-31"


def test_date_rule_per_file(spark, tmp):
    a = _write(f"{tmp}/dr/a.csv", "Police,Date souscription\nA,01/02/2024\nB,03/04/2024\n")
    b = _write(f"{tmp}/dr/b.csv", "Police,Date souscription\nC,inconnue\nD,?\n")
    given = Delivery.from_list(spark, [("2024", a), ("2024", b)])
    assert len(given.layouts) == 1
    out = prod.coerce_dates_by_file(given.rows())
    got = {r.Police: r["Date souscription"] for r in out.collect()}
    assert dict(out.dtypes)["Date souscription"] == "string"  # accepted by one file only
    assert got == {"A": "2024-02-01", "B": "2024-04-03", "C": "inconnue", "D": "?"}


def test_claims_file_with_unresolvable_headers(spark, tmp):
    bad = _write(f"{tmp}/badclaims/2024/c.csv", "Branche produit,Reglement,cout_total\nX,1,2\n")
    with pytest.raises(ValueError) as e:
        dim.read_claims_files(spark, [("2024", bad)], {})
    msg = str(e.value)
    assert "Colonnes manquantes: BRANCHE" in msg and "Reglement='Reglement'" in msg and "Colonnes disponibles" in msg


def test_one_scan_reads_every_layout_and_encoding(spark, tmp):
    """Layouts of other orders, widths, encodings and spellings, a blank and a doubled header, short and long rows."""
    texts = {"2020/a.csv": ("Police,Branche,Zone\nA,Café,1\nB,x\n", "utf-8"), "2021/b.csv": ("branche,Police\nÉté,C,beyond\n", "latin-1"),
             "2021/c.csv": ("Zone,,Police,Police\n9,8,D,E\n", "utf-8"), "slot=2022/d.csv": ("\ufeffPolice,Branche\nF,\"é, \"\"q\"\"\"\n", "utf-8"),
             "2022/empty.csv": ("", "utf-8"), "2022/head.csv": ("Police,Branche\n", "utf-8"), "2023/lines.csv": ("Branche,Police\n\"deux\nlignes ü\",G\n", "latin-1")}
    for name, (text, enc) in texts.items():
        _write(f"{tmp}/in/{name}", text, enc)
    given = Delivery.from_folders(spark, [f"{tmp}/in"])
    df = given.rows()
    assert df.columns == ["Branche", "Police", "Zone", "_c1", "Police2", "Police3", "__file", "__slot"]
    got = {
        (r["__slot"], r["Police"], r["Branche"], r["Zone"], r["_c1"], r["Police2"], r["Police3"]) for r in df.collect()}
    assert got == {("2020", "A", "Café", "1", None, None, None), ("2020", "B", "x", None, None, None, None), ("2021", "C", "Été", None, None, None, None),
                   ("2021", None, None, "9", "8", "D", "E"), ("2022", "F", 'é, "q"', None, None, None, None), ("2023", "G", "deux\nlignes ü", None, None, None, None)}
    scans = df._jdf.queryExecution().optimizedPlan().toString().count("csv")
    assert scans == 2                                       # one for cells without line feeds, one for those with
    assert "empty.csv" not in {r.name for r in given.facts.collect()}
    named = Delivery.from_list(spark, [("2022", f"{tmp}/in/2022/empty.csv"), ("2020", f"{tmp}/in/2020/a.csv")])
    assert {r.name: (r.size, r.lines) for r in named.facts.collect()} == {"empty.csv": (0, 0), "a.csv": (34, 3)}
    assert {r["Police"] for r in named.rows().collect()} == {"A", "B"}
    # one layout in folders: nothing has to be joined
    only = Delivery.from_folders(spark, [f"{tmp}/in/2020"])
    assert "Join" not in only.rows()._jdf.queryExecution().optimizedPlan().toString()
    assert {r["__slot"] for r in only.rows().collect()} == {"2020"}


def test_names_of_a_header():
    assert safe_names(["a", "", "A", "b"]) == ["a0", "_c1", "A2", "b"]


def test_rejections_are_rows(spark, tmp):
    _write(f"{tmp}/in/2023/good.csv", "Police,Branche,PN_ACC,Effet,Echeance\nA,X,1,2024-01-01,2024-12-31\n")
    _write(f"{tmp}/in/2024/bad.csv", "Police,PN_ACC\nA,1\n")
    _write(f"{tmp}/in/2024/none.csv", "\n")
    given = Delivery.from_folders(spark, [f"{tmp}/in"])
    got = {tuple(r) for r in given.rejections(["Police", "Branche", "PN_ACC", "Effet"]).collect()}
    assert got == {("2024", "bad.csv", "Branche, Effet", "Police, PN_ACC", "Police, PN_ACC"), ("2024", "none.csv", "Police, Branche, PN_ACC, Effet", "", "")}
    claims = {r.file: (r.missing, r.found) for r in given.rejections().collect()}
    assert claims == {"good.csv": ("REGLEMENT, COUT_TOTAL", "Branche=Branche"), "bad.csv": ("BRANCHE, REGLEMENT, COUT_TOTAL", ""), "none.csv": ("BRANCHE, REGLEMENT, COUT_TOTAL", "")}


def _policies(n, start=0, extra="", value=""):
    return f"Police,Branche,PN_ACC,Effet,Echeance{extra}\n" + "".join(f"P{start + i},X,{i + 1},2024-01-01,2024-12-31{value}\n" for i in range(n))


def test_landing_replaces_changed_slots_only(spark, tmp):
    root, target = f"{tmp}/in", f"{tmp}/table"
    for y in (2021, 2022, 2023):
        _write(f"{root}/{y}/a.csv", _policies(y - 2018, y))
    land = lambda: {r.slot: r.status for r in landing.land_changes(spark, Delivery.from_folders(spark, [root]), target).collect()}
    rows = lambda: {(r.Exercice, r.n, r.s) for r in landing.read_changes_landed(spark, target).groupBy("Exercice").agg(
        F.count(F.lit(1)).alias("n"), F.sum("PN_ACC").alias("s")).collect()}
    files = lambda y: set(os.listdir(f"{target}/Exercice={y}"))
    assert land() == {"2021": "landed", "2022": "landed", "2023": "landed"}
    assert rows() == {("2021", 3, 6.0), ("2022", 4, 10.0), ("2023", 5, 15.0)}
    first = {y: files(y) for y in (2021, 2022, 2023)}
    assert land() == {} and {y: files(y) for y in first} == first
    # another file in one slot, with a column of its own
    _write(f"{root}/2022/b.csv", _policies(1, 9, ",Zone", ",nord"))
    assert land() == {"2022": "landed"}
    assert rows() == {("2021", 3, 6.0), ("2022", 5, 11.0), ("2023", 5, 15.0)}
    assert files(2021) == first[2021] and files(2023) == first[2023] and files(2022) != first[2022]
    zones = landing.read_changes_landed(spark, target).groupBy("Zone").count().collect()
    assert {r.Zone: r["count"] for r in zones} == {None: 12, "nord": 1}
    # a slot goes, one comes, one has no row left
    os.remove(f"{root}/2023/a.csv")
    _write(f"{root}/2021/a.csv", _policies(0))
    _write(f"{root}/2024/a.csv", _policies(2))
    assert land() == {"2021": "removed", "2023": "removed", "2024": "landed"}
    assert rows() == {("2022", 5, 11.0), ("2024", 2, 3.0)}
    # a column of dates turns to text: all partitions have to follow
    _write(f"{root}/2024/b.csv", _policies(1, 0, ",Date souscription", ",01/02/2024"))
    assert land() == {"2024": "landed"} and dict(landing.read_changes_landed(spark, target).dtypes)["Date souscription"] == "date"
    _write(f"{root}/2022/c.csv", _policies(1, 0, ",Date souscription", ",inconnue"))
    assert land() == {"2022": "landed", "2024": "landed"}
    got = {(r.Exercice, r["Date souscription"]) for r in landing.read_changes_landed(spark, target).collect()}
    assert got == {("2022", None), ("2022", "inconnue"), ("2024", None), ("2024", "2024-02-01")}
    with pytest.raises(ValueError, match="Effet"):
        _write(f"{root}/2025/a.csv", "Police,Branche,PN_ACC,Echeance\nA,X,1,2024-12-31\n")
        os.remove(f"{root}/2022/b.csv")
        for y in (2022, 2024):
            _write(f"{root}/{y}/a.csv", "Police,Branche,PN_ACC,Echeance\nA,X,1,2024-12-31\n")
            for x in "bc":
                if os.path.exists(f"{root}/{y}/{x}.csv"):
                    os.remove(f"{root}/{y}/{x}.csv")
        land()
    assert {r[0] for r in rows()} == {"2022", "2024"}      # what was landed is still there


def test_common_types(spark):
    from pyspark.sql import types as T
    t = prod.common_type
    assert t([T.IntegerType(), T.LongType(), T.BooleanType()]) == T.LongType() and t([T.IntegerType(), T.DoubleType()]) == T.DoubleType()
    assert t([T.DateType(), T.TimestampNTZType()]) == T.TimestampNTZType() and t([T.DateType(), T.IntegerType()]) == T.StringType()
    assert t([T.NullType()]) == T.StringType() and t([T.DecimalType(10, 2), T.LongType()]) == T.DoubleType()
    with pytest.raises(ValueError, match="no common type"):
        t([T.BinaryType(), T.StringType()])
    a = spark.sql("SELECT 'A' AS Police, 1 AS x, true AS b, DATE '2024-05-06' AS d")
    b = spark.sql("SELECT 'B' AS Police, 2.5D AS X, 7L AS b, TIMESTAMP_NTZ '2024-05-06 07:08:09' AS d")
    c = spark.sql("SELECT 'C' AS Police, DATE '2023-01-02' AS x, NULL AS b")
    u = prod.union_production([("2020", a), ("2021", b), ("2022", c)])
    assert dict(u.dtypes) == {"Police": "string", "x": "string", "b": "bigint", "d": "timestamp_ntz", "Exercice": "string"}
    assert {(r.Police, r.x, r.b, str(r.d)) for r in u.collect()} == {("A", "1", 1, "2024-05-06 00:00:00"), ("B", "2.5", 7, "2024-05-06 07:08:09"), ("C", "2023-01-02", None, "None")}


def test_files_and_folders_of_any_name(spark, tmp):
    _write(f"{tmp}/in/2020/a b é%20+#&.csv", "Police,Branche,PN_ACC,Effet,Echeance\nA,X,1,2024-01-01,2024-12-31\n")
    _write(f"{tmp}/in/2021 bis/c[1].csv", "Branche,Police,PN_ACC,Effet,Echeance\nY,B,2,2024-01-01,2024-12-31\n")
    _write(f"{tmp}/in/{{x}}*/d?.csv", "Branche,Police,PN_ACC,Effet,Echeance\nZ,C,3,2024-01-01,2024-12-31\n")
    given = Delivery.from_folders(spark, [f"{tmp}/in"])
    want = {("2020", "A", "X"), ("2021 bis", "B", "Y"), ("{x}*", "C", "Z")}
    assert {r.slot: r.lines for r in given.facts.collect()} == {s: 2 for s, _, _ in want}
    rows = lambda g: {(r["__slot"], r["Police"], r["Branche"]) for r in g.rows().collect()}
    assert rows(given) == want
    for slot in ("2020", "2021 bis", "{x}*"):
        assert rows(given.only([slot])) == {w for w in want if w[0] == slot}
    assert rows(Delivery.from_list(spark, [("z", f"{tmp}/in/2020/a b é%20+#&.csv")])) == {("z", "A", "X")}
    assert {r.slot for r in landing.land_changes(spark, given, f"{tmp}/out").collect()} == {s for s, _, _ in want}
    assert landing.read_changes_landed(spark, f"{tmp}/out").count() == 3
