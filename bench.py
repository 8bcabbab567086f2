"""Headline-query benchmark.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Runs each headline query to completion (``noop`` sink: every row is
produced, nothing is collected to the driver) on ``local[$BENCH_CPUS]`` and
prints one JSON line with per-query seconds and their sum.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "near_pairs", "near_pairs_exact_bits", "exact_pairs", "duplicate_summary", "neighbours_before",
    "similar_all", "same_digest_all", "report_decision", "report_messages", "lsh_pairs",
    "miss_limit", "corpus_stats", "stream_pairs", "image_fingerprints",
]


def nested_loop_pairs(spark, sf_dir):
    """Reference point only: the stored-pair predicate written directly as a
    theta join (Spark plans it as a nested loop)."""
    from pyspark.sql import functions as F
    from dupstream.functions.bits import group_distance
    from dupstream.schemas import AHASH, DHASH_H, DHASH_V
    from dupstream.sources.tables import images_fx
    still = images_fx(spark, sf_dir).filter(~F.col("animated"))
    l, r = still.alias("l"), still.alias("r")
    cond = ((F.col("l.id") < F.col("r.id")) & (F.abs(F.col("l.bits") - F.col("r.bits")) <= 22)
            & (group_distance("l", "r", AHASH) <= 5) & (group_distance("l", "r", DHASH_H) <= 8)
            & (group_distance("l", "r", DHASH_V) <= 8))
    return l.join(r, cond).select("l.id", "r.id")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from dupstream.plans.queries import REGISTRY
    from dupstream.session import build_session
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=max(8, int(cpus) * 2),
                          extra={"spark.ui.showConsoleProgress": "false"})
    # warm-up: JVM, parquet footers, Python workers
    REGISTRY["near_pairs"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        t = time.perf_counter()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t, 3)
    n_images = REGISTRY["hash_scan"](spark, sf_dir).count()
    t = time.perf_counter()
    nested_loop_pairs(spark, sf_dir).write.format("noop").mode("overwrite").save()
    reference = {"near_pairs_nested_loop": round(time.perf_counter() - t, 3)}
    n_grids = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    n_arrivals = REGISTRY["popcounts"](spark, sf_dir).count()
    reference["image_fingerprints_images_per_sec"] = round(n_grids / max(times["image_fingerprints"], 1e-9), 1)
    reference["stream_pairs_rows_per_sec"] = round(n_arrivals / max(times["stream_pairs"], 1e-9), 1)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "still_images": n_images, "cpus": int(cpus),
                      "reference_points": reference}))
    spark.stop()


if __name__ == "__main__":
    main()
