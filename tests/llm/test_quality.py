import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import quality


def corpus(n=700):
    r = random.Random(3)
    words = "the and of to in river table green walking paper house quietly under window morning".split()
    rows = []
    for i in range(n):
        good = r.random() > (0.6 if i % 7 == 0 else 0.1)
        text = " ".join(r.choice(words) for _ in range(r.randint(5, 120)))
        if not good:
            text = r.choice([text.upper().replace(" ", "!! "), " ".join(w for w in text.split()[:5] for _ in range(12)), text.replace(" ", " | "), text.replace(" ", "%%% ")])
        rows.append((i, text, "bad-site" if i % 7 == 0 else f"s{i % 40}", "en" if i % 2 else None, int(good)))
    return rows


def test_evidence_rates_and_scores(spark):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, s, p, 9) for d, t, s, p, _ in rows] + [(9000, None, None, None, 9), (9001, "", "new", "x", 9)], "doc_id long, text string, source string, lang string, score int")
    labels = spark.createDataFrame([(d, y) for d, _, _, _, y in rows], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    assert len(got) == len(rows) + 2
    assert sum(got[d]["kept"] == bool(y) for d, _, _, _, y in rows) >= 0.97 * len(rows)
    # The rates again, from the evidence.
    groups, sites = {}, {}
    for r in got.values():
        for g, k in ((sites, r["site"]), (groups, (r["site"], r["path"]))):
            n, s = g.get(k, (0, 0.0))
            g[k] = n + 1, s + r["evidence"]

    def prior(g):
        n, s = np.array(list(g.values())).T
        m = s.sum() / n.sum()
        spread = (s * s / n).sum() - n.sum() * m * m - (len(n) - 1) * m * (1 - m)
        between = spread / (n.sum() - (n * n).sum() / n.sum())
        return m, min(1e4, max(1.0, m * (1 - m) / between - 1)) if between > 0 else 1e4

    (m, k), (_, inner) = prior(sites), prior(groups)
    for r in got.values():
        n, s = sites[r["site"]]
        rate = (s + m * k) / (n + k)
        assert r["site_rate"] == pytest.approx(rate)
        n, s = groups[r["site"], r["path"]]
        assert r["path_rate"] == pytest.approx((s + rate * inner) / (n + inner))
        odds = lambda p: np.log(np.clip(p, 1e-6, 1 - 1e-6) / (1 - np.clip(p, 1e-6, 1 - 1e-6)))
        z = odds((s - r["evidence"] + rate * inner) / (n - 1 + inner)) + odds(r["evidence"]) - odds(m)
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)
    assert got[7]["site_rate"] < got[8]["site_rate"]


def test_sparse_sites_shrink_to_the_corpus(spark):
    groups = spark.createDataFrame([(float(n), float(n) * p) for n, p in [(1000, 0.9), (1000, 0.2), (800, 0.6), (2, 1.0)]], "n double, good double")
    m, k = quality.shrinkage(groups, "n", "good")
    assert abs((2 + m * k) / (2 + k) - m) < abs(1.0 - m) and 1 <= k < 20


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string, lang string")
    assert quality.classify(docs, spark.createDataFrame([], "doc_id long, quality int")).collect() == []


def test_features_of_extreme_texts(spark):
    docs = spark.createDataFrame([(None,), ("",), (" \n",), ("a" * 200_000,), ("word " * 40_000,), ("日本語",)], "t string")
    assert all(all(np.isfinite(v) for v in r) for r in docs.select(*quality.features(F.col("t"))).collect())


def test_sites_decide_where_the_text_does_not(spark):
    """Half of the texts look alike whatever their label; the posteriors of their sites lower the error."""
    r = random.Random(11)
    words = "the and of to in river table green walking paper house quietly under window morning".split()
    rows = []
    for i in range(1500):
        site = r.randrange(30)
        good = r.random() < (0.95 if site % 2 else 0.05)
        text = " ".join(r.choice(words) for _ in range(r.randint(20, 60)))
        if r.random() < 0.5:
            text = text + " | x" * 3  # says nothing
        elif not good:
            text = text.upper().replace(" ", "!! ")
        rows.append((i, text, f"s{site}", "en", int(good)))
    docs = spark.createDataFrame([x[:4] for x in rows], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(x[0], x[4]) for x in rows], "doc_id long, quality int")
    got = {x["doc_id"]: x for x in quality.classify(docs, labels).collect()}
    alone = sum((got[d]["evidence"] >= quality.KEEP) != bool(y) for d, *_, y in rows)
    both = sum(got[d]["kept"] != bool(y) for d, *_, y in rows)
    assert both < 0.6 * alone


def test_repeated_rows_and_clashing_names(spark):
    rows = [(i % 60, "the house and the river " * (1 + i % 5), "s", "en", 1, 2.0, "x") for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, evidence int, score double, site string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] * 2, "doc_id long, quality int")
    got = quality.classify(docs, labels)
    assert got.count() == 90 and got.columns == ["doc_id", "site", "path", "evidence", "site_rate", "path_rate", "score", "kept"]
    assert got.select("doc_id", "score").distinct().count() == len({(r[0], r[1]) for r in rows})
