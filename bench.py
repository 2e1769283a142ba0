"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from trialweave.plans import catalog
from trialweave.session import local_session

HEADLINE = [
    "template_decode", "decode_with_permutations", "context_transfer", "split_half_similarity", "searchlight_template", "omnibus_rsa", "crossnobis",
    "candidate_rules", "join_interval_frames", "join_nearest_event", "describe_cells", "percentile_midpoint", "tied_rank", "bh_fdr_by_family",
    "join_radius_mm", "connected_components", "dvars", "rising_edges",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, cpus, "trialweave-bench")
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["fn_bits"](spark, sf).write.format("noop").mode("overwrite").save()  # start-up is not a query
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
