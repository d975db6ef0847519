"""Headline timings. Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) select data and cores, BENCH_RUNS
(default 3) how often each query runs. Every run starts from the tables: nothing is shared between
timed runs. ``queries`` has the median of each query's runs; ``build`` the part of it that passes until
the query hands out its result (intermediate tables it stores), ``run`` the rest.
"""

from __future__ import annotations

import json
import os
import time

from boursecraft.plans import QUERIES
from boursecraft.plans.shared import forget
from boursecraft.session import build_session, ensure_checkpoint_dir

HEADLINE = (
    "rec_current_metrics",
    "rec_live_metrics",
    "val_normalise_percent",
    "win_latest_per_provider",
    "win_select_canonical",
    "rec_archived",
    "win_close_per_day",
    "win_rsi_wilder",
    "ts_beta",
    "ts_derived_metrics",
    "sc_score_universe",
    "sc_lenses",
    "win_pct_rank",
    "win_ordinal_rank",
    "cmp_sections",
    "cmp_three_snapshots",
    "agg_delivery",
    "agg_deals",
    "src_chart_bars",
    "src_statements",
    "src_header_ratios",
    "dq_coverage_summary",
    "agg_failure_tally",
    "sink_bars_upsert",
    "scd_universe_sync",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").agg({"l_quantity": "sum"}).collect()
    found: dict[str, tuple[float, float, float]] = {}
    for name in HEADLINE:
        runs = []
        for _ in range(int(os.environ.get("BENCH_RUNS", "3"))):
            forget()
            start = time.perf_counter()
            result = QUERIES[name](spark, sf_dir)
            built = time.perf_counter()
            result.write.format("noop").mode("overwrite").save()
            done = time.perf_counter()
            runs.append((done - start, built - start, done - built))
        found[name] = sorted(runs)[len(runs) // 2]
    part = lambda k: {name: round(times[k], 3) for name, times in found.items()}
    total = round(sum(times[0] for times in found.values()), 3)
    print(json.dumps({"metric": "headline_total_seconds", "value": total, "unit": "sec", "queries": part(0), "build": part(1), "run": part(2), "sf": os.path.basename(sf_dir)}))
    spark.stop()


if __name__ == "__main__":
    main()
