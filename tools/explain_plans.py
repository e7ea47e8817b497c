"""Write the physical plans of the headline queries to PLANS.md (evidence of
pushed filters, pruned columns, broadcast joins and partial aggregation)."""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from provisio.operators import claims as co  # noqa: E402
from provisio.operators import premium  # noqa: E402
from provisio.operators.mapping import map_policies  # noqa: E402
from provisio.plans import catalog, pipeline  # noqa: E402
from provisio.session import build_session  # noqa: E402
from provisio.sources import fixtures as fx  # noqa: E402


def formatted(df) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session(shuffle_partitions=8)
    p = fx.fixture_params()
    st = catalog.policy_stage(spark, sf)
    sections = [
        ("Policy scan -> map literal -> one partial/final aggregation (policy_cells)",
         premium.policy_cells(map_policies(fx.policies_raw(spark, sf), p.mapping), p.date_eval)),
        ("Claims scan -> parse -> aggregation (claims_agg)",
         co.claims_agg(co.map_claims(fx.claims_raw(spark, sf), p.mapping))),
        ("Row-level PREC: policies joined to the rate table (prec_lines)",
         premium.prec_lines(st.mapped, st.taux, p.date_eval)),
        ("PE recap matrix over stored cells (pe_recap_matrix)", catalog.QUERIES["pe_recap_matrix"](spark, sf)),
        ("PSAP matrix over stored cells (psap_matrix)", catalog.QUERIES["psap_matrix"](spark, sf)),
        ("The whole report in one plan (reserving_report)", pipeline.reserving_report(*catalog.both_stages(spark, sf))),
        ("The last year of a landed table, found at run time (last_year_landed)", catalog.QUERIES["last_year_landed"](spark, sf)),
    ]
    out = ["# Physical plans (generated by tools/explain_plans.py)\n",
           f"Input: `{sf}`, `local[8]`. Plans are printed before execution (AQE may still coalesce or "
           "switch joins at run time).\n"]
    for title, df in sections:
        out.append(f"## {title}\n\n```\n{formatted(df).strip()}\n```\n")
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as f:
        f.write("\n".join(out))
    spark.stop()


if __name__ == "__main__":
    main()
