"""Time the headline queries.  Prints one JSON line.

``BENCH_SF_DIR`` (default sf0.1) and ``BENCH_CPUS`` (default 8) choose the data and the cores.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

import checks  # noqa: E402
from larder.session import local_session  # noqa: E402

HEADLINE = (
    "b15_impute",  # gap-free panel with estimates
    "b11_quality_report",  # every data check in one pass
    "j1_d1_f1_f2_engineered_features",  # training features
    "j2_future_features",  # leakage-free future features at nine decision dates
    "j12_f6_segmentation",  # ABC/XYZ with a distributed ranking
    "k1_i13_i18_backtest_metrics",  # 12 folds x 25 SKUs x 4 models
    "k1_backtest_with_holt_winters",  # 12 folds x 6 SKUs x 5 models, 27 grid points
    "l8_l9_recommendations",  # orders for every SKU at nine decision dates
    "l14_perishable_ledger",  # perishable stock over seven years
    "n1_n7_comparison",  # two policies replayed over half a year
    "n6_d14_h3_frontier",  # eight policy settings replayed
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    registered = checks.queries()
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 2)
    line = {"metric": "headline_total_seconds", "value": round(sum(times.values()), 2), "unit": "sec", "queries": times}
    print(json.dumps(line | {"sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
