"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``: one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pactframe.plans import load
from pactframe.plans.registry import PLANS, Source
from pactframe.session import local_session

HEADLINE = (
    "k4_summary", "k10_timeseries", "k17_waterfall", "k22_stage_map", "s3_classify", "p12_classify", "c5_sentences",
    "c7_pack", "c8_overlap_chunks", "c13_render", "r1_postings", "r4_bm25", "r5_nearest_scoped", "r8_fusion",
    "v1_hashed_bag", "a2_quote_anywhere", "a4_structure_errors", "a18_decisions", "a20_finalize", "t5_live_windows",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    load()
    spark = local_session(cores, int(cores) if cores.isdigit() else 8)
    source = Source(spark, folder)
    source.view("spans").count()
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        PLANS[name](source).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
