"""The fitted embedder against an exact decomposition, and the fitted pair scorer on pairs kept out."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import latent, metrics, pair_scorer, rerank


def topics(seed, n=120, words=12):
    r = random.Random(seed)
    return [(i, " ".join(r.choice([f"t{i % 6}w{r.randint(0, words)}", "the", f"x{r.randint(0, 60)}"]) for _ in range(r.randint(5, 40)))) for i in range(n)]


def plain_rows(texts, terms, idf):
    x = np.zeros((len(texts), len(terms)))
    for row, t in zip(x, texts, strict=True):
        for w, n in Counter(re.findall("[a-z0-9]+", t.lower())).items():
            if w in terms:
                row[terms.index(w)] = (1 + np.log(n)) * idf[terms.index(w)]
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def test_directions_are_those_of_an_exact_decomposition(spark, monkeypatch):
    monkeypatch.setattr(latent, "AT_ONCE", 50)
    docs = topics(1)
    model = latent.fit(spark.createDataFrame(docs, "chunk_id int, text string").repartition(5), dims=6, rounds=4)
    df = Counter(w for _, t in docs for w in set(t.split()))
    assert model.terms == sorted(df, key=lambda w: (-df[w], w))
    assert np.allclose(model.idf, [np.log((1 + len(docs)) / (1 + df[w])) + 1 for w in model.terms])
    x = plain_rows([t for _, t in docs], model.terms, model.idf)
    _, _, vt = np.linalg.svd(x, full_matrices=False)
    kept = np.linalg.norm(x @ model.directions) ** 2 / np.linalg.norm(x @ vt[:6].T) ** 2
    assert np.allclose(model.directions.T @ model.directions, np.eye(6), atol=1e-9) and kept > 0.999


def test_every_row_has_a_vector_and_topics_are_near(spark, tmp_path):
    docs = topics(2) + [(500, None), (501, ""), (502, "unknownword"), (503, "T1W1 t1w2")]
    frame = spark.createDataFrame(docs, "chunk_id int, text string").repartition(3)
    model = latent.fit(frame.where("chunk_id < 500"), dims=12)
    rows = {r.chunk_id: np.array(r.vector) for r in model(frame, ["chunk_id"], "text").collect()}
    assert rows.keys() == {i for i, _ in docs} and all(np.linalg.norm(rows[i]) == 0 for i in (500, 501, 502))
    assert all(abs(np.linalg.norm(rows[i]) - 1) < 1e-9 for i in rows if i < 500)
    inside, across = [np.mean([rows[i] @ rows[j] for i in range(60) for j in range(i) if (i % 6 == j % 6) == same]) for same in (True, False)]
    assert inside > across + 0.2
    latent.save(model, spark, f"{tmp_path}/model")
    again = latent.load(spark, f"{tmp_path}/model")
    assert all(np.allclose(r.vector, rows[r.chunk_id]) for r in again(frame, ["chunk_id"], "text").collect())
    assert latent.fit(frame.limit(0)).directions.shape == (0, 1)


def test_no_direction_outweighs_another(spark):
    """What nearly all chunks share must not hide what few share: over all chunks each scaled direction has the same sum of squares."""
    docs = topics(4)
    model = latent.fit(spark.createDataFrame(docs, "chunk_id int, text string"), dims=6, rounds=4)
    x = plain_rows([t for _, t in docs], model.terms, model.idf)
    plain, scaled = (((x @ d) ** 2).sum(0) for d in (model.directions, model.directions * model.scale))
    assert plain.max() > 3 * plain.min() and np.allclose(scaled, 1, atol=1e-4)
    rows = x @ (model.directions * model.scale)
    assert np.allclose(model.vectors([t for _, t in docs]), rows / np.linalg.norm(rows, axis=1, keepdims=True), atol=1e-5)


def test_more_terms_than_wanted(spark):
    docs = topics(3, 40)
    model = latent.fit(spark.createDataFrame(docs, "chunk_id int, text string"), dims=50, terms=10)
    assert len(model.terms) == 10 and model.directions.shape == (10, 10)


def pairs(seed, n=60):
    """Texts that hold the words of the question in a row (label 1), or scattered among others."""
    r, out = random.Random(seed), []
    for i in range(n):
        q = [f"w{r.randint(0, 200)}" for _ in range(6)]
        for c in range(5):
            rest = [f"w{r.randint(0, 200)}" for _ in range(60)]
            at = r.randint(0, 50)
            text = rest[:at] + q + rest[at:] if c == 4 else r.sample(rest + q, 66)
            out.append((i, c, " ".join(q), " ".join(text), c + 1, int(c == 4)))
    return out


def test_a_fitted_scorer_is_better_than_shared_terms(spark):
    schema = "query_id int, chunk_id int, question string, text string, rank int, label int"
    train, held = (spark.createDataFrame(pairs(s), schema) for s in (1, 2))
    model = pair_scorer.fit(train)
    items = held.where("label = 1").select("query_id", F.lit("single_hop").alias("type"), F.array("chunk_id").alias("gold"))
    mrr = lambda scorer: metrics.evaluate(rerank.rerank(held, 5, scorer), items, 5, "x").first().mrr_at_k
    assert mrr(model.scorer()) > 0.95 > 0.5 > mrr(rerank.overlap)
    again = pair_scorer.fit(train.repartition(7))
    assert np.array_equal(model.weights, again.weights), "the order of rows changes nothing"
    with pytest.raises(ValueError):
        pair_scorer.fit(train.where("label = 1"))


def test_every_pair_counts_in_the_fit(spark):
    """One label has 6,000 pairs: weights are those of a plain regression over all of them, each as often as it is there."""
    r = random.Random(3)
    rows = [(" ".join(q := [f"w{r.randint(0, 30)}" for _ in range(6)]), " ".join(r.sample(q, r.randint(1, 6)) + [f"w{r.randint(0, 30)}" for _ in range(r.randint(5, 30))]), 0) for _ in range(6000)]
    rows += [(q, f"{t} {q}" if i % 3 else t, 1) for i, (q, t, _) in enumerate(rows[:400])]
    rows += [(None, "a", 1), ("a", None, 0), ("a b", "a b", 2), ("a b", "a b", None)]
    model = pair_scorer.fit(spark.createDataFrame(rows, "question string, text string, label int"))
    x = pair_scorer.features([q for q, _, _ in rows[:6400]], [t for _, t, _ in rows[:6400]])
    y = np.array([v for _, _, v in rows[:6400]])
    mean, scale = x.mean(0), x.std(0)
    mean[-1], scale[-1] = 0, 1
    scale[scale < 1e-9] = 1
    x, w, each = (x - mean) / scale, np.zeros(7), np.where(y == 1, 6400 / 800, 6400 / 12000)
    for _ in range(40):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x * (each * p * (1 - p))[:, None]).T @ x + np.eye(7), x.T @ (each * (p - y)) + w)
    assert np.allclose(model.mean, mean, atol=1e-9) and np.allclose(model.scale, scale, atol=1e-9) and np.allclose(model.weights, w, atol=1e-7)


def test_features():
    x = pair_scorer.features(["a b c d", "", "a a"], ["x a b c y d", "some text", "A, a!"])
    assert x[0, :4].tolist() == [1.0, 2 / 3, 0.5, 0.75] and x[1, :4].tolist() == [0, 0, 0, 0] and x[2, :4].tolist() == [1.0, 1.0, 0.0, 1.0]


def test_a_model_is_loaded_once_a_task_and_called_by_length(spark):
    def load():
        sizes = []

        def score(questions, texts):
            assert len(questions) <= 4 and [len(q) + len(t) for q, t in zip(questions, texts, strict=True)] == sorted(len(q) + len(t) for q, t in zip(questions, texts, strict=True))
            sizes.append(len(questions))
            return np.array([len(t) for t in texts], float)

        return score

    rows = spark.createDataFrame([(i, "q", "t" * ((i * 7) % 23)) for i in range(23)] + [(90, None, "t"), (91, "q", None)], "i int, q string, t string").coalesce(1)
    got = {r.i: r.s for r in rows.select("i", pair_scorer.model_scorer(load, 4)(F.col("q"), F.col("t")).alias("s")).collect()}
    assert got == {i: float((i * 7) % 23) for i in range(23)} | {90: None, 91: None}
