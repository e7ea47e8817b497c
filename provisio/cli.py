"""Command line: land yearly files, run the method, write every table and the report.

    python -m provisio.cli --production IN/production --claims IN/claims \
        --params params.json --out OUT

``--production`` and ``--claims`` hold one sub-folder per year slot
(``Exercice=2024/`` or ``2024/``) with CSV files; ``params.json`` carries the
run parameters (see ``ReservingParams``).  Outputs: the landed production
table (Parquet, partitioned by Exercice), one CSV per presented table and the
report cells.
"""

from __future__ import annotations

import argparse
import json
from datetime import date

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from provisio.params import ReservingParams
from provisio.plans.pipeline import ReservingPipeline
from provisio.plans.report import write_report
from provisio.sources import dimensions as dim
from provisio.sources import landing
from provisio.sources.delivery import Delivery


def load_params(path: str) -> ReservingParams:
    with open(path, encoding="utf-8") as f:
        raw = json.load(f)
    kw = dict(raw)
    if "date_eval" in kw:
        kw["date_eval"] = date.fromisoformat(kw["date_eval"])
    for k in ("platform_shares", "guarantee_shares", "psap_overrides"):
        if k in kw:
            kw[k] = [tuple(x) for x in kw[k]]
    return ReservingParams(**kw)


def run(spark: SparkSession, production: str, claims: str, params: ReservingParams, out: str,
        comments: dict | None = None) -> dict:
    landed = f"{out}/landed/production"
    landing.land_changes(spark, Delivery.from_folders(spark, [production]), landed)     # a second run lands what has changed
    policies = landing.read_changes_landed(spark, landed)
    claims_df = dim.read_claims_files(spark, Delivery.from_folders(spark, [claims]), params.mapping)
    pipe = ReservingPipeline(policies, claims_df, params, claims_prepared=True)
    tables = pipe.run()
    for name, df in tables.items():
        safe = name.replace(" ", "_").lower()
        df.write.mode("overwrite").option("header", True).csv(f"{out}/tables/{safe}")
    write_report(pipe.report(comments), f"{out}/report")
    return {"landed": landed, "tables": sorted(tables), "report": f"{out}/report",
            "psap_total": pipe.psap.agg(F.sum("PSAP")).first()[0]}


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    ap.add_argument("--production", required=True)
    ap.add_argument("--claims", required=True)
    ap.add_argument("--params", required=True)
    ap.add_argument("--out", required=True)
    ap.add_argument("--comments", help="JSON file {section key: comment}")
    a = ap.parse_args(argv)
    from provisio.session import build_session
    spark = build_session()
    comments = None
    if a.comments:
        with open(a.comments, encoding="utf-8") as f:
            comments = json.load(f)
    print(json.dumps(run(spark, a.production, a.claims, load_params(a.params), a.out, comments), default=str))


if __name__ == "__main__":
    main()
