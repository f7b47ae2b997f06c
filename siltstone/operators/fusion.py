"""Reciprocal rank fusion of ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators.sparse import top_k


def rrf_scores(lists: DataFrame, k: int = 60) -> DataFrame:
    """``query_id, chunk_id, rrf_score`` from rows ``query_id, chunk_id, rank`` of any number of lists; a repeat adds again."""
    if k <= 0:
        raise ValueError("k must be positive")
    return lists.groupBy("query_id", "chunk_id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("rrf_score"))


def hybrid(dense: DataFrame, sparse: DataFrame, top: int = 10, k: int = 60, digits: int = 8) -> DataFrame:
    """Fused hits with each list's rank and score; ties by dense rank, then sparse rank."""
    if k <= 0:
        raise ValueError("k must be positive")
    d = dense.select("query_id", "chunk_id", F.col("rank").alias("dense_rank"), F.col("score").alias("dense_score"))
    s = sparse.select("query_id", "chunk_id", F.col("rank").alias("sparse_rank"), F.col("score").alias("sparse_score"))
    both = d.join(s, ["query_id", "chunk_id"], "full_outer")
    part = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    fused = both.withColumn("rrf_score", F.round(part("dense_rank") + part("sparse_rank"), digits))
    return top_k(fused, top, [F.col("rrf_score").desc(), F.col("dense_rank").asc_nulls_last(), F.col("sparse_rank").asc_nulls_last()])


def first_seen(hits: DataFrame, query_no: str = "query_no") -> DataFrame:
    """Union of the lists of a question's sub-queries: each chunk at its first sighting, by (query_no, rank)."""
    from pyspark.sql import Window as W

    seen = F.row_number().over(W.partitionBy("query_id", "chunk_id").orderBy(query_no, "rank"))
    once = hits.withColumn("_n", seen).where("_n = 1").drop("_n")
    return once.withColumn("position", F.row_number().over(W.partitionBy("query_id").orderBy(query_no, "rank")))
