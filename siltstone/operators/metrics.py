"""Retrieval metrics: array expressions for one ranking, and aggregates for a whole run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _check(k: int) -> None:
    if k <= 0:
        raise ValueError("k must be positive")


def recall(retrieved: Column, gold: Column, k: int) -> Column:
    """1 if any gold id is among the first k."""
    _check(k)
    return F.coalesce(F.arrays_overlap(F.slice(retrieved, 1, k), gold), F.lit(False)).cast("double")


def reciprocal_rank(retrieved: Column, gold: Column, k: int) -> Column:
    _check(k)
    ranks = F.filter(F.transform(F.slice(retrieved, 1, k), lambda c, i: F.when(F.array_contains(gold, c), i + 1)), lambda r: r.isNotNull())
    return F.coalesce(1.0 / F.array_min(ranks), F.lit(0.0))


def ideal_dcg(n_gold: Column, k: int) -> Column:
    n = F.least(n_gold, F.lit(k))
    return F.when(n <= 0, F.lit(0.0)).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0.0), lambda s, r: s + 1.0 / F.log2(r + 1)))


def ndcg(retrieved: Column, gold: Column, k: int) -> Column:
    """Each retrieved repeat of a gold id counts; k <= 0 or no gold gives 0."""
    if k <= 0:
        return F.lit(0.0)
    gains = F.transform(F.slice(retrieved, 1, k), lambda c, i: F.when(F.array_contains(gold, c), 1.0 / F.log2(i + 2)).otherwise(0.0))
    dcg, ideal = F.aggregate(gains, F.lit(0.0), lambda s, x: s + x), ideal_dcg(F.size(gold), k)
    return F.when(ideal > 0, dcg / ideal).otherwise(0.0)


def per_query(hits: DataFrame, items: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """``query_id, n_gold, rank_of_first_gold, recall, mrr, ndcg`` for each scorable item.

    ``hits`` has ``query_id, chunk_id, rank``; ``items`` ``query_id, type, gold`` (array). Items of type
    no_answer are left out; an item whose hits hold no gold scores 0.
    """
    _check(k)
    wanted = items.where("type <> 'no_answer'").select("query_id", "gold", F.size("gold").alias("n_gold"))
    gold = wanted.select("query_id", F.explode(F.array_distinct("gold")).alias("chunk_id"))
    found = hits.where(F.col("rank") <= k).join(gold, ["query_id", "chunk_id"]).groupBy("query_id").agg(F.min("rank").alias("rank_of_first_gold"), F.sum(1.0 / F.log2(F.col("rank") + 1)).alias("dcg"))
    each = wanted.join(found, "query_id", "left")
    ideal = ideal_dcg(F.col("n_gold"), k)
    return each.select(
        "query_id", "n_gold", "rank_of_first_gold", F.col("rank_of_first_gold").isNotNull().cast("double").alias("recall"), F.round(F.coalesce(1.0 / F.col("rank_of_first_gold"), F.lit(0.0)), digits).alias("mrr"),
        F.round(F.when(ideal > 0, F.coalesce("dcg", F.lit(0.0)) / ideal).otherwise(0.0), digits).alias("ndcg"),
    )


def evaluate(hits: DataFrame, items: DataFrame, k: int, config: str, strategy: str = "recursive", digits: int = 6) -> DataFrame:
    """``config_name, strategy, top_k, n_evaluated, n_no_answer, recall_at_k, mrr_at_k, ndcg_at_k``; without scorable items ValueError."""
    _check(k)
    counts = items.agg(F.count_if(F.col("type") != "no_answer").alias("n_evaluated"), F.count_if(F.col("type") == "no_answer").alias("n_no_answer"))
    if not items.where("type <> 'no_answer'").take(1):
        raise ValueError("no scorable items")
    means = per_query(hits, items, k, 12).agg(*[F.round(F.avg(c), digits).alias(f"{c}_at_k") for c in ("recall", "mrr", "ndcg")])
    return counts.join(F.broadcast(means)).select(F.lit(config).alias("config_name"), F.lit(strategy).alias("strategy"), F.lit(k).alias("top_k"), "n_evaluated", "n_no_answer", "recall_at_k", "mrr_at_k", "ndcg_at_k")


def ablation_row(timestamp: Column) -> Column:
    """A run of ``evaluate`` as a row of the markdown table."""
    return F.format_string("| %s | %s | %s | %.3f | %.3f | %.3f | %s | %s |", "config_name", "strategy", "top_k", "recall_at_k", "mrr_at_k", "ndcg_at_k", "n_evaluated", F.substring(timestamp, 1, 16))
