"""Time the headline queries: one JSON line. BENCH_SF_DIR, BENCH_CPUS; BENCH_ALL=1 times every query."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tapeloom.plans import REGISTRY  # noqa: E402
from tapeloom.session import local_session  # noqa: E402

HEADLINE = [
    "T1_review_queue", "J8_review_rows", "S2_classify_sections", "A1_bin_frames", "A3_make_segments", "A4_segment_stats",
    "A5_norm_gain", "A10_silence_intervals", "V3_knn", "V5_match_songs", "V9_self_similarity_tiles", "Q1_novelty_curve",
    "Q2_boundaries", "Q4_passages", "Q7_change_points", "Q8_passage_points", "G2_passage_types", "W15_auto_classify",
    "W_mixed_decisions", "W_mixed_candidates",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    names = list(REGISTRY) if os.environ.get("BENCH_ALL") else HEADLINE
    run(REGISTRY["T1_review_queue"].build(spark, folder))  # warm-up
    times = {}
    for name in names:
        t0 = time.time()
        run(REGISTRY[name].build(spark, folder))
        times[name] = round(time.time() - t0, 3)
        if os.environ.get("BENCH_ALL"):
            print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total seconds over headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
