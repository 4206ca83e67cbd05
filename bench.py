"""Times the headline queries and prints one JSON line.

`prepare_*` is the first derivation of each panel from the order tables, run once. The others are
the median of three warm runs, each computed in full into a sink that keeps nothing.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from hearthpanel.session import local_session

HEADLINE = ["lagged_panel", "hh_vars", "transition_by_sex_age", "transition_conditional", "pair_methods",
            "gini", "percentile_ratios", "income_by_year", "median_by_age", "status_by_subgroup",
            "dispersion_by_horizon", "error_histograms", "complete_panel", "mark_separations", "flag_births",
            "score_cascade", "score_status_blend", "standardize", "knn_candidates"]


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    from hearthpanel.plans import frames, load_all
    from hearthpanel.plans.registry import QUERIES
    load_all()
    sink = lambda df: df.write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in ("panel", "full", "lags", "ana"):
        seconds[f"prepare_{name}"] = timed(lambda: getattr(frames, name)(spark, folder))
    for name in HEADLINE:
        runs = [timed(lambda: sink(QUERIES[name](spark, folder))) for _ in range(4)]
        seconds[name] = statistics.median(runs[1:])
        print(f"{name} {seconds[name]:.2f}", file=sys.stderr, flush=True)
    seconds = {k: round(v, 3) for k, v in seconds.items()}
    print(json.dumps({"metric": "panel_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": folder.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
