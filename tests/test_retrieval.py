import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from siltstone.functions import text
from siltstone.operators import dense, fusion, metrics, rerank, rewrite, sparse
from siltstone.plans import retrieval

CHUNKS = [("a", "s", "sparse retrieval with inverted index"), ("b", "s", "dense retrieval with vectors and vectors"), ("c", "s", "the cat sat on the mat the end"), ("d", "s", "the the the common words"), ("e", "s", "")]


@pytest.fixture(scope="module")
def corpus(spark):
    return retrieval.Corpus.of(spark.createDataFrame(CHUNKS, "chunk_id string, section_title string, text string"))


def ask(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id int, text string")


def test_terms(spark):
    t = "Hello, World-2 BM25 café x_y"
    assert spark.createDataFrame([(t,)], "t string").select(text.terms(F.col("t"))).first()[0] == ["hello", "world", "2", "bm25", "caf", "x", "y"]


def test_bm25_scores(spark, corpus):
    docs = {c: t.split() for c, _, t in CHUNKS}
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    df = Counter(w for ws in docs.values() for w in set(ws))
    raw = {w: math.log(n - k + 0.5) - math.log(k + 0.5) for w, k in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {w: v if v >= 0 else 0.25 * mean for w, v in raw.items()}
    question = "the retrieval retrieval vectors missing"
    want = {}
    for c, ws in docs.items():
        s = sum(idf.get(w, 0) * ws.count(w) * 2.5 / (ws.count(w) + 1.5 * (0.25 + 0.75 * len(ws) / avg)) for w in question.split())
        if s > 0:
            want[c] = round(s, 6)
    got = {r["chunk_id"]: r["score"] for r in retrieval.search_sparse(corpus, ask(spark, question), 10).collect()}
    assert got == pytest.approx(want)
    assert retrieval.search_sparse(corpus, ask(spark, "", "  ", "zzz"), 10).count() == 0
    with pytest.raises(ValueError):
        retrieval.search_sparse(corpus, ask(spark, "x"), 0)


def test_index_round_trip(spark, corpus, tmp_path):
    with pytest.raises(FileNotFoundError):
        sparse.load(spark, f"{tmp_path}/none")
    sparse.save(corpus.index, f"{tmp_path}/i")
    one, two = (sparse.search(i, ask(spark, "dense vectors"), 3).collect() for i in (corpus.index, sparse.load(spark, f"{tmp_path}/i")))
    assert one == two and one[0]["chunk_id"] == "b"


def test_dense_blocks_give_the_same(spark, monkeypatch):
    v = spark.createDataFrame([(i, [float(i % 3), 1.0, float(i)]) for i in range(20)] + [(99, [0.0, 0.0, 0.0])], "chunk_id int, vector array<double>")
    q = spark.createDataFrame([(i, [1.0, float(i), 0.5]) for i in range(7)], "query_id int, vector array<double>")
    want = sorted(map(tuple, dense.search(v, q, 4).collect()))
    monkeypatch.setattr(dense, "BLOCK", 2)
    assert sorted(map(tuple, dense.search(v, q, 4).collect())) == want and len(want) == 28


def test_fusion(spark):
    lists = spark.createDataFrame([(0, "x", 1), (0, "x", 2), (0, "y", 1)], "query_id int, chunk_id string, rank int")
    got = {r["chunk_id"]: r["rrf_score"] for r in fusion.rrf_scores(lists).collect()}
    assert got == pytest.approx({"x": 1 / 61 + 1 / 62, "y": 1 / 61})
    schema = "query_id int, chunk_id string, rank int, score double"
    d, s = spark.createDataFrame([(0, "x", 1, 0.9), (0, "y", 2, 0.8)], schema), spark.createDataFrame([(0, "z", 1, 5.0), (0, "x", 2, 4.0)], schema)
    rows = fusion.hybrid(d, s, 3).orderBy("rank").collect()
    assert [r["chunk_id"] for r in rows] == ["x", "z", "y"] and rows[1]["dense_rank"] is None and rows[2]["sparse_score"] is None
    for f in (lambda: fusion.rrf_scores(lists, 0), lambda: fusion.hybrid(d, s, 3, 0)):
        with pytest.raises(ValueError):
            f()


def test_rerank_keeps_order_of_ties(spark):
    rows = spark.createDataFrame([(0, c, "alpha beta", t, i + 1) for i, (c, t) in enumerate([("p", "beta"), ("q", "alpha beta"), ("r", "alpha"), ("s", "")])], "query_id int, chunk_id string, question string, text string, rank int")
    got = rerank.rerank(rows, None).orderBy("rank").collect()
    assert [(r["chunk_id"], r["rrf_rank"]) for r in got] == [("q", 2), ("p", 1), ("r", 3), ("s", 4)]
    longest = rerank.pandas_scorer(lambda q, t: t.str.len().astype(float))
    assert rerank.rerank(rows, 1, longest).first()["chunk_id"] == "q"


def test_hybrid_and_reranked_search(spark, corpus):
    q = ask(spark, "dense vectors", "")
    assert retrieval.search_hybrid(corpus, q, 2).orderBy("rank").first()["chunk_id"] == "b"
    hits = retrieval.search_reranked(corpus, q, 2).collect()
    assert {r["query_id"] for r in hits} == {0} and len(hits) == 2


def test_rewrites(spark, corpus):
    raw = spark.createDataFrame([('```json\n["One", 1, " two ", "", null, "three", "four"]\n```',), ("no list",), (None,)], "raw string")
    assert [r[0] for r in raw.select(rewrite.multi_query(F.col("raw"), 3)).collect()] == [["One", "two", "three"], [], []]
    assert [r[0] for r in raw.select(rewrite.multi_query(F.col("raw"), 0)).collect()] == [[], [], []]
    assert [r[0] for r in spark.createDataFrame([("```text\nA passage.\n```",), ("  ",), (None,)], "raw string").select(rewrite.hyde(F.col("raw"))).collect()] == [["A passage."], [], []]
    x = spark.createDataFrame([(" Q? ", ["q?", "Other", "", "other", "New"])], "o string, r array<string>")
    assert x.select(rewrite.distinct_queries(F.col("o"), F.col("r"))).first()[0] == ["Q?", "Other", "New"]
    q = ask(spark, "dense vectors")
    rewrites = spark.createDataFrame([(0, ["cat mat", "inverted index"])], "query_id int, rewrites array<string>")
    found = {r["chunk_id"]: r["rerank_score"] for r in retrieval.search_rewritten(corpus, q, rewrites, 5).collect()}
    assert found["b"] == 1.0 and "c" in found
    assert {r["question"] for r in retrieval.search_rewritten(corpus, q, rewrites, 5, "hyde").collect()} == {"dense vectors"}
    with pytest.raises(ValueError):
        rewrite.sub_queries(q, strategy="other")


def test_first_sighting_wins(spark):
    hits = spark.createDataFrame([(0, 0, "a", 1), (0, 0, "b", 2), (0, 1, "b", 1), (0, 1, "c", 2)], "query_id int, query_no int, chunk_id string, rank int")
    assert [(r["chunk_id"], r["query_no"], r["position"]) for r in fusion.first_seen(hits).orderBy("position").collect()] == [("a", 0, 1), ("b", 0, 2), ("c", 1, 3)]


CASES = [(["a", "b", "c"], ["a"], 3), (["a", "b", "c"], ["c"], 3), (["a", "b", "c"], ["c"], 2), (["a", "b"], [], 2), ([], ["a"], 2), (["a", "a", "b"], ["a", "a"], 3), (["x", "a", "b"], ["a", "b", "z"], 10)]


def test_metrics(spark):
    for retrieved, gold, k in CASES:
        row = spark.createDataFrame([(retrieved, gold)], "r array<string>, g array<string>")
        got = row.select(metrics.recall(F.col("r"), F.col("g"), k), metrics.reciprocal_rank(F.col("r"), F.col("g"), k), metrics.ndcg(F.col("r"), F.col("g"), k)).first()
        ranks = [i + 1 for i, c in enumerate(retrieved[:k]) if c in gold]
        ideal = sum(1 / math.log2(i + 2) for i in range(min(len(gold), k)))
        assert tuple(got) == pytest.approx((float(bool(ranks)), 1 / ranks[0] if ranks else 0, sum(1 / math.log2(r + 1) for r in ranks) / ideal if ideal else 0))
    for f in (metrics.recall, metrics.reciprocal_rank):
        with pytest.raises(ValueError):
            f(F.col("r"), F.col("g"), 0)


def test_evaluate(spark):
    items = spark.createDataFrame([(1, "single_hop", ["a"]), (2, "single_hop", ["b"]), (3, "single_hop", ["z"]), (4, "no_answer", [])], "query_id int, type string, gold array<string>")
    hits = spark.createDataFrame([(1, "a", 1), (2, "x", 1), (2, "y", 2), (2, "b", 3), (3, "x", 1), (4, "x", 1)], "query_id int, chunk_id string, rank int")
    run = metrics.evaluate(hits, items, 10, "sparse")
    r = run.first()
    assert (r["n_evaluated"], r["n_no_answer"], r["recall_at_k"], r["mrr_at_k"]) == (3, 1, 0.666667, round((1 + 1 / 3) / 3, 6))
    assert run.select(metrics.ablation_row(F.lit("2024-05-01T10:20:30"))).first()[0] == "| sparse | recursive | 10 | 0.667 | 0.444 | 0.500 | 3 | 2024-05-01T10:20 |"
    for bad, k in ((items.where("type = 'no_answer'"), 10), (items, 0)):
        with pytest.raises(ValueError):
            metrics.evaluate(hits, bad, k, "x")




def test_compared_searches_each_index_once(spark, corpus, monkeypatch):
    q = ask(spark, "dense vectors", "the cat", "common inverted index", "")
    plain = {"sparse": retrieval.search_sparse, "dense": retrieval.search_dense, "hybrid": retrieval.search_hybrid, "rerank": retrieval.search_reranked}
    rows = lambda hits: sorted(map(str, hits.select(sorted(hits.columns)).collect()))
    want = {name: rows(search(corpus, q, 2)) for name, search in plain.items()}
    calls = []
    for module in (sparse, dense):
        monkeypatch.setattr(module, "search", lambda *a, _f=module.search, **k: calls.append(1) or _f(*a, **k))
    got = retrieval.compared(corpus, q, 2)
    assert len(calls) == 2 and {name: rows(hits) for name, hits in got.items()} == want
