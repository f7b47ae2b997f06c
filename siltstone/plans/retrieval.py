"""Retrievers as plans: a batch of questions in, ranked hits out.

A retriever maps questions ``(query_id, text)`` to hits ``(query_id, chunk_id, rank, score...)``. Only
ids and scores travel through scoring and fusion; texts are joined to the few candidates at the end.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import strip
from siltstone.functions.vectors import hash_bag
from siltstone.operators import ann, dense, fusion, grounding, rerank, rewrite, sparse
from siltstone.sources.scratch import stored

#: (rows, id columns, text column) -> id columns and a normalised ``vector``
Embedder = Callable[[DataFrame, list[str], str], DataFrame]


@dataclass
class Corpus:
    """Chunks ``(chunk_id, section_title, text)`` with their sparse index and vectors."""

    chunks: DataFrame
    index: sparse.SparseIndex
    vectors: DataFrame
    embed: Embedder = hash_bag
    ann: ann.AnnIndex | None = None  # where given, vector search looks into the nearest cells only

    @classmethod
    def of(cls, chunks: DataFrame, embed: Embedder = hash_bag) -> Corpus:
        return cls(chunks, sparse.build(chunks), stored(embed(chunks, ["chunk_id"], "text")), embed)


def _asked(questions: DataFrame, keys: list[str]) -> DataFrame:
    """Blank questions retrieve nothing."""
    return questions.select(*keys, "text").where(strip(F.coalesce("text", F.lit(""))) != "")


def search_sparse(corpus: Corpus, questions: DataFrame, k: int = 10) -> DataFrame:
    return sparse.search(corpus.index, _asked(questions, ["query_id"]), k)


def search_dense(corpus: Corpus, questions: DataFrame, k: int = 10) -> DataFrame:
    asked = corpus.embed(_asked(questions, ["query_id"]), ["query_id"], "text")
    return ann.search(corpus.ann, asked, k) if corpus.ann else dense.search(corpus.vectors, asked, k)


def search_hybrid(corpus: Corpus, questions: DataFrame, k: int = 10, fan_out: int = 50, rrf_k: int = 60) -> DataFrame:
    return fusion.hybrid(search_dense(corpus, questions, fan_out), search_sparse(corpus, questions, fan_out), k, rrf_k)


def _texts(corpus: Corpus, hits: DataFrame, questions: DataFrame) -> DataFrame:
    named = corpus.chunks.select("chunk_id", "section_title", "text")
    return hits.join(named, "chunk_id").join(questions.select("query_id", F.col("text").alias("question")), "query_id")


def search_reranked(corpus: Corpus, questions: DataFrame, k: int = 10, fan_out: int = 50, scorer: rerank.Scorer = rerank.overlap, rrf_k: int = 60) -> DataFrame:
    """Hybrid candidates, then the pair scorer on those alone."""
    return rerank.rerank(_texts(corpus, search_hybrid(corpus, questions, fan_out, fan_out, rrf_k), questions), k, scorer)


def compared(corpus: Corpus, questions: DataFrame, k: int = 10, fan_out: int = 50, scorer: rerank.Scorer = rerank.overlap, rrf_k: int = 60) -> dict[str, DataFrame]:
    """The hits of the configurations sparse, dense, hybrid and rerank, for which each index is searched once.

    A list of k is the head of a longer one, as ranks are unique. With an index of cells (``corpus.ann``)
    the longer search may find more than a search for k alone.
    """
    found = [stored(search(corpus, questions, max(k, fan_out))) for search in (search_dense, search_sparse)]
    fused = stored(fusion.hybrid(*[f.where(F.col("rank") <= fan_out) for f in found], max(k, fan_out), rrf_k))
    first = [x.where(F.col("rank") <= k) for x in (*found, fused)]
    reranked = rerank.rerank(_texts(corpus, fused.where(F.col("rank") <= fan_out), questions), k, scorer)
    return {"sparse": first[1], "dense": first[0], "hybrid": first[2], "rerank": reranked}


def search_rewritten(corpus: Corpus, questions: DataFrame, rewrites: DataFrame, k: int = 10, strategy: str = "multi_query", fan_out: int = 50, scorer: rerank.Scorer = rerank.overlap, rrf_k: int = 60) -> DataFrame:
    """Candidates of all sub-queries, each at its first sighting, reranked against the original question.

    ``rewrites`` has ``query_id, rewrites`` (array). All sub-queries are searched as one batch.
    """
    joined = questions.select("query_id", F.col("text").alias("question")).join(rewrites, "query_id", "left").withColumn("rewrites", F.coalesce("rewrites", F.array().cast("array<string>")))
    sub = rewrite.sub_queries(joined, "rewrites", strategy)
    named = sub.select(F.struct("query_id", "query_no").alias("query_id"), "text")
    hits = search_hybrid(corpus, named, fan_out, fan_out, rrf_k)
    flat = hits.select(F.col("query_id.query_id").alias("query_id"), F.col("query_id.query_no").alias("query_no"), "chunk_id", "rank", "rrf_score")
    seen = fusion.first_seen(flat).drop("rank", "query_no")
    return rerank.rerank(_texts(corpus, seen, questions), k, scorer, "position")


def answer(corpus: Corpus, questions: DataFrame, model: grounding.Model, hits: DataFrame | None = None, k: int = 3, fan_out: int = 50, chars: int = 1500, least: int = 15) -> DataFrame:
    """Retrieve, prompt, and verify: one answer per question."""
    found = hits if hits is not None else search_reranked(corpus, questions, k, fan_out)
    contexts = found.select("query_id", "chunk_id", "section_title", "text", "rank")
    return grounding.generate(questions.select("query_id", F.col("text").alias("question")), contexts, model, chars, least)


def search_by_model(corpus: Corpus, questions: DataFrame, model: grounding.Model, strategy: str = "multi_query", k: int = 10, n: int = 3, fan_out: int = 50, scorer: rerank.Scorer = rerank.overlap, rrf_k: int = 60) -> DataFrame:
    """``search_rewritten`` with rewrites that a model gives; where it fails, the original question alone."""
    return search_rewritten(corpus, questions, stored(rewrite.rewrites(questions, model, strategy, n)), k, strategy, fan_out, scorer, rrf_k)


def answer_rewritten(corpus: Corpus, questions: DataFrame, model: grounding.Model, strategy: str = "multi_query", k: int = 3, n: int = 3, fan_out: int = 50) -> DataFrame:
    """As ``answer``, over the passages that the rewritten search finds."""
    return answer(corpus, questions, model, search_by_model(corpus, questions, model, strategy, k, n, fan_out), k, fan_out)


def search(config: str, corpus: Corpus, questions: DataFrame, k: int = 10, model: grounding.Model | None = None, n: int = 3, fan_out: int = 50, rrf_k: int = 60) -> DataFrame:
    """One of the six configurations by name; the last two need a model."""
    plain = {
        "sparse": lambda: search_sparse(corpus, questions, k), "dense": lambda: search_dense(corpus, questions, k),
        "hybrid": lambda: search_hybrid(corpus, questions, k, fan_out, rrf_k), "rerank": lambda: search_reranked(corpus, questions, k, fan_out, rrf_k=rrf_k),
    }
    if config in plain:
        return plain[config]()
    if config not in REWRITING:
        raise ValueError(f"config must be one of {', '.join([*plain, *REWRITING])}")
    if model is None:
        raise ValueError(f"{config} needs a model")
    return search_by_model(corpus, questions, model, REWRITING[config], k, n, fan_out, rrf_k=rrf_k)


#: Configurations that rewrite questions, with their strategy.
REWRITING = {"multi-query": "multi_query", "hyde": "hyde"}
CONFIGS = ["sparse", "dense", "hybrid", "rerank", *REWRITING]
