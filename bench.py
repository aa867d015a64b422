"""Bench: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and print one JSON line.

Each query runs to completion through the ``noop`` sink (every row is produced, nothing is
collected to the driver). Session start-up and a warm-up pass of every headline query over the
smallest data set are not timed, so the numbers are steady-state.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "split_sentences",
    "mine_cluster_pairs",
    "mine_cluster_pairs_docs",
    "scan_labelled_pairs",
    "overlap_report",
    "build_pairs_v6",
    "candidate_scores",
    "select_grounded",
    "select_meaning_gate",
    "contextual_synonyms",
    "paragraph_requests",
    "grammar_requests",
]


def main() -> int:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    os.environ.setdefault("PARAFORGE_MASTER", f"local[{cpus}]")
    os.environ.setdefault("PARAFORGE_SHUFFLE_PARTITIONS", str(max(8, int(cpus) * 2)))

    from paraforge.plans import catalog
    from paraforge.session import get_session

    spark = get_session(app_name="paraforge-bench")
    # Untimed warm-up: every headline query once on the smallest data set (JIT, Python workers).
    warm_dir = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    for name in names:
        catalog.QUERIES[name](spark, warm_dir).write.format("noop").mode("overwrite").save()

    times: dict[str, float] = {}
    for name in names:
        t0 = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(f"# {name}: {times[name]}s", file=sys.stderr)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
