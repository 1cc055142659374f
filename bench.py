"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs to completion through the ``noop`` sink (the whole plan executes, nothing is
collected).  Every headline query first runs once on the smallest fixture (sf0.001) so that JVM
warm-up, Python worker start and code generation are paid before timing; that pass is reported as
``warmup_sec`` and the timed numbers are steady-state runs at ``$BENCH_SF_DIR``.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["align_blocks", "doc_status", "rebuild_new", "inline_diff", "score_changes", "analyze_changes",
            "stats_by_type", "toc", "doc_summary", "snapshot_cell_diff", "table_diff", "text_cosine",
            "embedding_cosine"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from palimpsest.session import get_spark
    from palimpsest.plans.queries import queries
    spark = get_spark(f"local[{cpus}]", int(cpus))
    qs = queries()
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    t_warm = time.time()
    for name in names:
        qs[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
    warmup = round(time.time() - t_warm, 3)
    timings = {}
    for name in names:
        t0 = time.time()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.time() - t0, 3)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_total", "value": round(sum(timings.values()), 3), "unit": "sec",
                      "queries": timings, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
                      "warmup_sec": warmup}))
    spark.stop()


if __name__ == "__main__":
    main()
