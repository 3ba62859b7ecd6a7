"""Times the headline queries once each and prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")  # a task has one core; Python workers inherit it

HEADLINE = ["r1_bm25", "r3_tfidf", "r4_hybrid", "r8_vector_top", "s6_select_context", "h2_h7_hygiene", "h1_exact_duplicates", "u3_keep_newest", "p9_tags", "a2_command_metrics", "a4_latency", "st1_trailing_requests", "w4_drift", "g6_output_guard", "e10_consistency", "c4_context"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.driver.host", "127.0.0.1").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from gleanery import queries as base

    spark.read.parquet(f"{sf}/documents.parquet").count()
    took = {}
    for name in HEADLINE:
        began = time.time()
        base.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
