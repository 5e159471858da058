"""Headline timings, one JSON line.

``$BENCH_SF_DIR`` names the tables and ``$BENCH_CPUS`` the local cores. Every query is run twice and counts with
its second run; the first one, which also writes the shared tables that it is the first to need, is given as ``cold``.
``model_results_all`` is the whole pipeline from raw tables to all 2,327 configurations, on a warehouse
of its own; ``daily_kpis``, ``fact_orders`` and ``dim_customers`` also start from raw tables. The other queries read the
derived tables, as a dashboard would.
"""

from __future__ import annotations

import json
import os
import sys
import time

from revwatch.plans import warehouse
from revwatch.plans.registry import QUERIES, run
from revwatch.session import build_session, intermediates

HEADLINE = (
    "fact_orders", "dim_customers", "daily_kpis", "daily_kpis_by_state", "zscore_alerts", "monthly_growth",
    "pareto_quintiles", "state_segments", "cancel_rate", "freight_by_weight", "order_value_hist", "top20_share",
    "rca_method", "roc_auc", "bootstrap_ci", "mann_whitney", "events_daily_kpis", "events_alerts", "question_intents",
)


def execute(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(name: str, spark, sf_dir: str) -> float:
    start = time.time()
    with intermediates(spark):
        execute(run(name, spark, sf_dir))
    return round(time.time() - start, 3)


def full_grid(spark, sf_dir: str) -> float:
    """Raw tables to the seven-family grid, nothing reused."""
    start = time.time()
    execute(QUERIES["model_results_all"](warehouse.Warehouse(spark, sf_dir)))
    return round(time.time() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "revwatch-bench", f"local[{cpus}]", **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "20g",
            "spark.checkpoint.dir": os.environ.get("BENCH_CHECKPOINT_DIR", f"/tmp/revwatch-bench-{os.getpid()}"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    times, cold = {}, {}
    for name in names:
        cold[name] = timed(name, spark, sf_dir)
        times[name] = timed(name, spark, sf_dir)
    if not sys.argv[1:]:
        times["model_results_all"] = full_grid(spark, sf_dir)
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries, warm",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "cold": cold,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
