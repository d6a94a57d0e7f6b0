"""Headline questions at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import logging
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lociframe import get_session, plans  # noqa: E402

HEADLINE = [
    "a_meth_by_feature", "j_within_feature", "j_multisample", "j_feature_overlap", "j_nearest_feature", "j_allpairs",
    "a_autocorr_pearson", "a_feature_stats", "a_cpg_venn", "a_reads_to_cytosines", "a_base_composition", "a_nmer_counts",
    "w_scan_fixed", "w_domains", "w_clusters", "w_complement_merged", "w_feat_align_avg", "w_nucleosome_score", "g_calls",
    "u_add_tracks", "k_top_nmers", "t_tumbling_counts",
]


def main() -> None:
    logging.disable(logging.CRITICAL)
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    names = sys.argv[1:] or HEADLINE
    spark = get_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    known = plans.load()
    times: dict[str, float] = {}
    for name in names:
        best = None
        for _ in range(2):  # the second run is warm
            t0 = time.perf_counter()
            known[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - t0
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
    print(json.dumps({"metric": "headline questions, warm wall time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir).removeprefix("sf")}))


if __name__ == "__main__":
    main()
