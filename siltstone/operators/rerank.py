"""Reranking of few candidates by a pair scorer."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import terms
from siltstone.operators.sparse import top_k

#: (question, text) -> score
Scorer = Callable[[Column, Column], Column]


def overlap(question: Column, text: Column) -> Column:
    """A stand-in for a learned scorer: the share of the question's distinct terms that the text has."""
    q = F.array_distinct(terms(question))
    return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.round(F.size(F.array_intersect(q, terms(text))) / F.size(q), 6))


def pandas_scorer(score: Callable[[pd.Series, pd.Series], pd.Series]) -> Scorer:
    """A batch scoring function as a scorer; batches go to Python workers by Arrow."""
    return F.pandas_udf(score, "double")


def rerank(candidates: DataFrame, top: int | None = 10, scorer: Scorer = overlap, position: str = "rank") -> DataFrame:
    """``candidates`` (query_id, chunk_id, question, text, position) with ``rerank_score`` and the new ``rank``.

    ``rrf_rank`` keeps the place before; ties keep that order. ``top`` None keeps all.
    """
    scored = candidates.withColumnRenamed(position, "rrf_rank").withColumn("rerank_score", scorer(F.col("question"), F.col("text")))
    return top_k(scored, top if top is not None else (1 << 31) - 1, [F.col("rerank_score").desc(), F.col("rrf_rank")])
