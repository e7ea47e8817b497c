"""Command-line run over yearly CSV folders (land, compute, write tables and report)."""

import json
import os
import tempfile

from provisio import cli


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_cli_end_to_end(spark):
    root = tempfile.mkdtemp(prefix="provisio-cli-")
    _write(f"{root}/production/Exercice=2023/p.csv",
           "Police,Branche,PN_ACC,Effet,Echeance\nA1,AUTO,1000,01/01/2023,31/12/2023\nB1,CORPO,500,01/07/2023,30/06/2024\n")
    _write(f"{root}/production/Exercice=2024/p.csv",
           "Police,Branche,PN_ACC,Effet,Echeance\nA2,AUTO,\"2 000,00\",01/01/2024,31/12/2024\n")
    _write(f"{root}/claims/2023/c.csv", "BRANCHE,REGLEMENT,COUT_TOTAL\nAUTO,100,300\nCORPO,10,50\n")
    params = {"date_eval": "2024-06-30", "frais_generaux": 100.0,
              "mapping": {"AUTO": "AUTOMOBILE", "CORPO": "DOMMAGES CORPORELS"},
              "loss_ratios": {"AUTOMOBILE": 0.7, "DOMMAGES CORPORELS": 0.8},
              "loss_ratios_split": {"AUTO RC": 0.75, "AUTO AR": 0.6, "DOMMAGES CORPORELS": 0.72},
              "platform_shares": [["2023", 0.65, 0.35], ["2024", 0.78, 0.22]]}
    with open(f"{root}/params.json", "w") as f:
        json.dump(params, f)
    res = cli.run(spark, f"{root}/production", f"{root}/claims", cli.load_params(f"{root}/params.json"), f"{root}/out",
                  comments={"PE": "Production émise"})
    assert {"PE", "PSAP", "SAP", "Taux PREC"} <= set(res["tables"])
    pe = spark.read.option("header", True).csv(f"{root}/out/tables/pe")
    total = pe.filter("Branche = 'TOTAL'").first()
    assert float(total["Total"]) == 3500.0 and float(total["2023"]) == 1500.0
    rep = spark.read.option("header", True).csv(f"{root}/out/report")
    assert rep.filter("col_name = 'comment'").first()["value_text"] == "Production emise"
    assert res["psap_total"] is not None
