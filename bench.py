"""Headline queries, timed one after the other; prints one JSON line.

Each query runs once to warm up and is then timed writing to Spark's no-op sink, so the
whole result is computed and nothing is kept. ``fit_map_sweep`` is one EM iteration
over stored histories, the mean of a few.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from recapspark.operators import hmm
from recapspark.plans import registry

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
QUERIES = [
    "growth_month",
    "target_d",
    "eh_long_main",
    "history_counts",
    "hmm_loglik",
    "posterior_summary",
    "prepare_captures",
    "keep_first_obs",
    "xtab_water_n",
    "state_trajectories",
    "length_histogram",
    "phi_means",
]


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str):
        frame = registry.QUERIES[name](spark, SF_DIR)
        return lambda: frame.write.format("noop").mode("overwrite").save()

    seconds = {}
    for name in QUERIES:
        run(name)()
        seconds[name] = timed(lambda: run(name)())

    observed = registry._model_input(spark, SF_DIR).persist()
    sweeps = 10
    hmm.fit_map(observed, registry.DELTA, max_iter=2)
    took = timed(lambda: hmm.fit_map(observed, registry.DELTA, max_iter=1, tol=-1))
    more = timed(lambda: hmm.fit_map(observed, registry.DELTA, max_iter=1 + sweeps, tol=-1))
    seconds["fit_map_sweep"] = round(max(more - took, 0) / sweeps, 3)
    rows = {
        "captures": spark.read.parquet(f"{SF_DIR}/orders.parquet").count(),
        "draws": spark.read.parquet(f"{SF_DIR}/events.parquet").count(),
        "histories": observed.count(),
    }
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total seconds over headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "rows": rows,
                "cpus": int(CPUS),
            }
        )
    )


if __name__ == "__main__":
    main()
