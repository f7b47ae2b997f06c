"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Queries of retrieval build their index inside; besides, an index is built once (``index_build``) and
searched for all questions (``search_*``, and ``ms_per_question``).
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from siltstone.operators import ann
from siltstone.plans import queries as plans
from siltstone.plans import retrieval
from siltstone.plans.queries import QUERIES
from siltstone.sources.scratch import scratch

HEADLINE = [
    "bm25_topk", "dense_knn", "hybrid_topk", "rerank_topk", "retrieval_eval", "sections_segment", "chunk_fixed", "chunk_recursive", "chunk_stats", "quote_verify", "abstention", "faithfulness",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf}/documents.parquet").agg({"doc_id": "max"}).collect()  # the session's own start is not measured
    took = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    began = time.time()
    corpus, questions = plans._corpus(spark, sf), plans._questions(spark, sf)
    took["index_build"], n, each = round(time.time() - began, 3), questions.count(), {}
    for config in ("sparse", "dense", "hybrid", "rerank"):
        began = time.time()
        retrieval.search(config, corpus, questions, 10).write.format("noop").mode("overwrite").save()
        took[f"search_{config}"] = round(time.time() - began, 3)
        each[config] = round(1000 * took[f"search_{config}"] / max(1, n), 1)
    began = time.time()
    corpus.ann = ann.build(corpus.vectors, scratch(spark))
    took["ann_build"], began = round(time.time() - began, 3), time.time()
    retrieval.search("dense", corpus, questions, 10).write.format("noop").mode("overwrite").save()
    took["search_ann"] = round(time.time() - began, 3)
    each["ann"] = round(1000 * took["search_ann"] / max(1, n), 1)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(took[k] for k in HEADLINE), 3), "unit": "sec", "queries": took, "ms_per_question": each, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
