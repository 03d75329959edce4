"""Times the headline queries; prints one JSON line. BENCH_SF_DIR: tables (default sf0.1); BENCH_CPUS: cores (default 8)."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from lodestone.plans import catalogue

HEADLINE = [
    "knn_cosine", "knn_euclidean", "knn_dot", "knn_manhattan", "knn_chebyshev", "knn_filtered", "knn_many_queries", "similarity_matrix", "pairwise_distances", "normalize_l2", "pool_mean", "pool_mean_normalized", "label_centroids",
    "rerank_exact", "rerank_mmr", "quantize_int8", "hamming_topk", "ivf_search", "knn_graph", "tokenize_simple", "wordpiece_encode", "chunk_sentences", "chunk_characters", "text_hash", "cache_lookup_exact", "store_upsert_latest",
    "micro_batches", "latency_percentiles", "rate_sliding_window", "rate_token_bucket",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    catalogue.QUERIES[names[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts the JVM's and the workers' code
    took = {}
    for name in names:
        t = time.perf_counter()
        catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - t, 3)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
