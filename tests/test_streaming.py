"""Structured Streaming landing and incremental claims cells."""

import os
import tempfile

from pyspark.sql import functions as F

from provisio.operators.claims import claims_agg, map_claims
from provisio.sources import production as prod
from provisio.streaming.landing import land_production_stream, maintain_claims_cells, read_cells

HEADER = ["BRANCHE", "GARANTIE", "REGLEMENT", "COUT_TOTAL"]


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_incremental_claims_cells_equal_batch(spark):
    root = tempfile.mkdtemp(prefix="provisio-stream-")
    _write(f"{root}/in/Exercice=2023/a.csv", "BRANCHE,GARANTIE,REGLEMENT,COUT_TOTAL\nAUTO,RC,100,150\nAUTO,RC,\"1 000,5\",2000\n")
    q = maintain_claims_cells(spark, f"{root}/in", HEADER, {"AUTO": "AUTOMOBILE"}, f"{root}/cells", f"{root}/ck")
    q.awaitTermination(120)
    _write(f"{root}/in/Exercice=2024/b.csv", "BRANCHE,GARANTIE,REGLEMENT,COUT_TOTAL\nTRANSPORT,x,5,-\nAUTO,y,1,2\n")
    q = maintain_claims_cells(spark, f"{root}/in", HEADER, {"AUTO": "AUTOMOBILE"}, f"{root}/cells", f"{root}/ck")
    q.awaitTermination(120)
    got = {(r.Branche, r.Exercice): (r.Total_Reglement, r.Cout_Total, r.Nombre_Sinistres, r.SAP)
           for r in read_cells(spark, f"{root}/cells").collect()}
    batch_in = prod.read_text_csv(spark, [f"{root}/in"])
    want = {(r.Branche, r.Exercice): (r.Total_Reglement, r.Cout_Total, r.Nombre_Sinistres, r.SAP)
            for r in claims_agg(map_claims(batch_in, {"AUTO": "AUTOMOBILE"})).collect()}
    assert got == want
    assert got[("AUTOMOBILE", "2023")] == (1100.5, 2150.0, 2, 1049.5)


def test_production_stream_landing(spark):
    root = tempfile.mkdtemp(prefix="provisio-pstream-")
    header = ["Exercice", "Police", "Branche", "PN_ACC", "Effet", "Echeance"]
    _write(f"{root}/in/Exercice=2024/a.csv",
           "Exercice,Police,Branche,PN_ACC,Effet,Echeance\n1999,P1, AUTO ,\"1 234,5\",01/02/2024,31/01/2025\n")
    q = land_production_stream(spark, f"{root}/in", header, f"{root}/out", f"{root}/ck")
    q.awaitTermination(120)
    r = prod.read_landed(spark, f"{root}/out").first()
    assert (r.Exercice, r.Branche, r.PN_ACC, str(r.Effet)) == ("2024", "AUTO", 1234.5, "2024-02-01")
    assert dict(prod.read_landed(spark, f"{root}/out").dtypes)["Effet"] == "date"
    assert prod.read_landed(spark, f"{root}/out").filter(F.col("Police") == "P1").count() == 1


def test_restart_without_new_files_is_idempotent(spark):
    root = tempfile.mkdtemp(prefix="provisio-restart-")
    _write(f"{root}/in/Exercice=2023/a.csv", "BRANCHE,GARANTIE,REGLEMENT,COUT_TOTAL\nAUTO,RC,100,150\n")
    for _ in range(2):                              # second run: same checkpoint, no new file
        q = maintain_claims_cells(spark, f"{root}/in", HEADER, {}, f"{root}/cells", f"{root}/ck")
        q.awaitTermination(120)
    rows = [(r.Branche, r.Exercice, r.Nombre_Sinistres, r.SAP) for r in read_cells(spark, f"{root}/cells").collect()]
    assert rows == [("AUTO", "2023", 1, 50.0)]


def test_streamed_cells_may_hold_line_feeds(spark):
    root = tempfile.mkdtemp(prefix="provisio-lines-")
    _write(f"{root}/in/Exercice=2023/a.csv", "BRANCHE,GARANTIE,REGLEMENT,COUT_TOTAL\nAUTO,\"RC\net vol\",100,150\n\"SANTE\n\",x,\"1\n000\",5\n")
    q = maintain_claims_cells(spark, f"{root}/in", HEADER, {}, f"{root}/cells", f"{root}/ck", multi_line=True)
    q.awaitTermination(120)
    rows = {(r.Branche, r.Exercice, r.Nombre_Sinistres, r.Total_Reglement) for r in read_cells(spark, f"{root}/cells").collect()}
    assert rows == {("AUTO", "2023", 1, 100.0), ("SANTE", "2023", 1, 1000.0)}
    header = ["Police", "Branche", "PN_ACC", "Effet", "Echeance"]
    _write(f"{root}/prod/Exercice=2024/a.csv", "Police,Branche,PN_ACC,Effet,Echeance\n\"P\n1\",AUTO,5,01/02/2024,31/01/2025\n")
    q = land_production_stream(spark, f"{root}/prod", header, f"{root}/out", f"{root}/ck2", multi_line=True)
    q.awaitTermination(120)
    assert [(r.Police, r.PN_ACC) for r in prod.read_landed(spark, f"{root}/out").collect()] == [("P\n1", 5.0)]
