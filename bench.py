"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from evisift.operators import routing
from evisift.plans import queries, tables
from evisift.session import build_session, release_pins

HEADLINE = (
    "assess_cases", "assess_cases_nested", "assess_cases_spread", "slot_rollup", "classification_report",
    "risk_gate", "prob_metrics", "case_features", "perturbation_matrix", "policy_rank", "routing_outcome",
    "risk_coverage", "budget_select", "knapsack_bound", "retrieve_topk", "assess_documents", "hygiene_scan",
    "corpus_fingerprint", "intake_batch", "latency_summary", "calibrated_scores",
)


def route_by_ranges(spark, sf):
    """The same routing with every queue treated as too large for a task."""
    rows = 4_000
    return routing.route(
        queries.known_items(spark, sf), ["queue"], ("risk",), routing.RISK_COVERAGE_CAPACITIES,
        max_group_rows=rows, part_rows=rows,
    )


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]", "bench",
        **{
            "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g",
            "spark.sql.shuffle.partitions": cpus,
        },
    )
    spark.sparkContext.setLogLevel("OFF")
    registry = queries.registry()
    work = {name: registry[name] for name in HEADLINE}
    work |= {"paired_bootstrap_1000": registry["paired_bootstrap"], "route_by_ranges": route_by_ranges}
    # start the JVM, the codegen cache and the file listing outside the timings
    registry["case_status_counts"](spark, folder).collect()
    seconds = {}
    for name, query in work.items():
        start = time.perf_counter()
        query(spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        # the result has left Spark, so its intermediate tables can go
        release_pins(spark)
        print(name, seconds[name], file=sys.stderr, flush=True)
    cases = tables.cases(spark, folder).count()
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": Path(folder).name, "cpus": int(cpus), "cases": cases,
        "assessed_cases_per_sec": round(cases / seconds["assess_cases"]),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
