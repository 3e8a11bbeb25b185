"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from wordmill import plans

HEADLINES = ("unigram_counts", "continuations_top3", "known_bigrams", "governors", "pair_model", "lane_evidence", "completions_top3", "next_word_top3", "fuzzy_neighbours", "ranked_candidates", "sentence_quality", "clicks_before_purchase", "learned_words", "merged_replicas", "trends", "part_search")


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINES:
        runs = []
        for _ in range(2):  # the first run also compiles
            began = time.perf_counter()
            plans.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        times[name] = round(min(runs), 3)
    print(json.dumps({"metric": "median seconds of headline queries", "value": round(statistics.median(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
