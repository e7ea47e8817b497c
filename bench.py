"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed to completion (small results collected, row-level
results written to the no-op sink); every query first runs once untimed
(JVM JIT and codegen warm-up for its own code paths), then the per-query
figure is the median of $BENCH_REPS timed runs.  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from provisio.plans import catalog  # noqa: E402
from provisio.session import build_session  # noqa: E402

HEADLINE = [
    "pe_recap_matrix", "taux_prec", "prec_recap_matrix", "pa_recap_matrix", "pa_split_matrix",
    "cu_matrix", "ibnr_by_exercice", "claims_agg", "claims_sap_matrix", "psap_matrix",
    "report_cells", "prec_lines", "date_anomalies", "claims_amount_parse",
]
ROW_LEVEL = {"prec_lines", "date_anomalies", "claims_amount_parse"}


def run(spark, name, sf_dir):
    t0 = time.perf_counter()
    df = catalog.QUERIES[name](spark, sf_dir)
    if name in ROW_LEVEL:
        df.write.format("noop").mode("overwrite").save()
    else:
        df.collect()
    return time.perf_counter() - t0


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    reps = int(os.environ.get("BENCH_REPS", "3"))
    only = os.environ.get("BENCH_QUERIES")
    names = only.split(",") if only else HEADLINE
    spark = build_session(master=f"local[{cpus}]", app="provisio-bench", shuffle_partitions=cpus)
    per_query, failed = {}, {}
    for name in names:
        try:
            run(spark, name, sf_dir)                # untimed warm-up of this query's code paths
            times = [run(spark, name, sf_dir) for _ in range(reps)]
            per_query[name] = round(statistics.median(times), 3)
        except Exception as e:  # noqa: BLE001 - report and keep measuring the others
            failed[name] = str(e).splitlines()[0][:200]
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    out = {"metric": "sum_of_median_query_seconds", "value": round(sum(per_query.values()), 3),
           "unit": "sec", "queries": per_query, "sf": sf, "cpus": cpus, "reps": reps}
    if failed:
        out["failed"] = failed
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
