"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from turnweave import catalog

QUERIES = (
    "f5_turns", "f6_coalesced", "f7_chunks", "f9_batches", "j1_overlaps", "j1_binned", "j2_dominant_speaker", "j3_nearest_speaker", "j5_as_of_word",
    "a1_words", "a2_sentences", "a3_merged_sentences", "f3_filled_words", "f8_regions", "j4_translated", "k4_srt", "k9_markdown", "j7_changed", "a15_roots", "a7_summary",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    known = catalog.queries()
    spark.read.parquet(f"{sf_dir}/events.parquet").count()
    seconds = {}
    for name in QUERIES:
        known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up: compile
        best = None
        for _ in range(2):
            began = time.perf_counter()
            known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - began
            best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
    print(json.dumps({"metric": "total seconds of headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf_dir}))


if __name__ == "__main__":
    main()
