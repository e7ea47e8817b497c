"""The method's sample inputs as fixtures (FIXTURES.md sections 1 and 2)."""

import os
import tempfile

from provisio.operators.claims import claims_agg
from provisio.operators.mapping import map_policies
from provisio.operators.recap import cells, recap_matrix
from provisio.sources import dimensions as dim
from provisio.sources import production as prod

CLAIMS_SAMPLE = """BRANCHE,GARANTIE,REGLEMENT,COUT_TOTAL
AUTOMOBILE,RC,500000.0,750000.0
AUTOMOBILE,Dommages,250000.0,400000.0
AUTOMOBILE,Vol,100000.0,150000.0
INCENDIES,Incendie,1000000.0,1500000.0
INCENDIES,Dégâts des eaux,150000.0,200000.0
TRANSPORT,Marchandises,300000.0,500000.0
TRANSPORT,Corps,200000.0,350000.0
SANTE,Maladie,450000.0,600000.0
"""

PRODUCTION_SAMPLE = """Exercice,Police,Client,Branche,Categorie,Intermediaire,Prime_Nette,Accessoires,Effet,Echeance
2024,POL001,Client A,AUTO,Cat1,Agent 1,100000.0,5000.0,2024-01-01,2025-01-01
2024,POL002,Client B,INCENDIE,Cat2,Agent 2,50000.0,2500.0,2024-03-15,2025-03-15
2024,POL003,Client C,SANTE,Cat1,Agent 1,75000.0,3750.0,2024-06-01,2025-06-01
2024,POL004,Client D,TRANSPORT,Cat3,Agent 3,30000.0,1500.0,2024-09-01,2025-09-01
"""


def _file(text, name):
    d = tempfile.mkdtemp(prefix="provisio-sample-")
    path = os.path.join(d, name)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def test_claims_sample_aggregate(spark):
    claims = dim.read_claims_files(spark, [("2024", _file(CLAIMS_SAMPLE, "sinistres.csv"))], {})
    got = {r.Branche: (r.Total_Reglement, r.Cout_Total, r.Nombre_Sinistres, r.SAP) for r in claims_agg(claims).collect()}
    assert got == {"AUTOMOBILE": (850000.0, 1300000.0, 3, 450000.0), "INCENDIES": (1150000.0, 1700000.0, 2, 550000.0),
                   "SANTE": (450000.0, 600000.0, 1, 150000.0), "TRANSPORT": (500000.0, 850000.0, 2, 350000.0)}
    total = {r.Branche: r for r in recap_matrix(claims_agg(claims), "SAP", ["2024"]).collect()}["TOTAL"]
    assert (total["2024"], total["Total"]) == (1500000.0, 1500000.0)


def test_production_sample_with_derived_premium(spark):
    landed = prod.read_production_files(spark, [("2024", _file(PRODUCTION_SAMPLE, "production.csv"))])
    policies = map_policies(prod.derive_pn_acc(landed), {"AUTO": "AUTOMOBILE"})
    pe = cells(policies, PE=policies["PN_ACC"])
    m = {r.Branche: r["2024"] for r in recap_matrix(pe, "PE", ["2024"]).collect()}
    assert m == {"AUTOMOBILE": 105000.0, "INCENDIE": 52500.0, "SANTE": 78750.0, "TRANSPORT": 31500.0, "TOTAL": 267750.0}
