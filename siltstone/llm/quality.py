"""Quality by hierarchical empirical Bayes: a text's own evidence with posteriors of its site and path.

A logistic classifier over features of the text, worked out by Spark's own functions, gives each
document's evidence. Sites are beta-binomial: their rates are shrunk toward the corpus rate with a
strength fitted by the method of moments, so that a site with few documents stays near the prior and
a large one speaks for itself. Paths are shrunk toward their site in the same way. A document's score
is the odds of its path, itself left out, times its own evidence.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import stored
from siltstone.llm.spotsigs import ANCHORS, _pattern

KEEP = 0.5


def features(text: Column) -> list[Column]:
    """Features of a whole text; null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(t), F.lit(1)).cast("double")
    words = F.greatest(F.regexp_count(t, F.lit(r"\S+")), F.lit(1)).cast("double")
    bare = F.regexp_replace(t, r"[\p{L}\s]+", "")
    return [
        F.log1p(words),
        F.length(bare) / n,
        F.length(F.regexp_replace(t, r"[^\p{Lu}]+", "")) / n,
        F.size(F.array_distinct(F.split(F.lower(t), r"\s+"))) / words,
        F.regexp_count(t, F.lit(r"(?<!\S)(\S+)\s+\1(?!\S)")) / words,
        F.regexp_count(F.lower(t), F.lit(rf"(?<![\p{{L}}\p{{N}}]){_pattern(ANCHORS)}(?![\p{{L}}\p{{N}}])")) / words,
        F.least(n / words, F.lit(40.0)),
        F.length(F.regexp_replace(bare, r"[.,;:'\"()?\-\p{N}]+", "")) / words,
    ]


def _spread(x: np.ndarray) -> np.ndarray:
    """The features, their squares and pairs."""
    pairs = [x[:, i] * x[:, j] for i in range(x.shape[1]) for j in range(i, x.shape[1])]
    return np.column_stack([x, *pairs])


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, scale and weights (the last: base) of a ridge logistic fit by Newton's method; without both labels the weights are 0."""
    if len(y) == 0:
        x = np.zeros((1, x.shape[1] if x.ndim == 2 else 8))
        y = np.zeros(1)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.column_stack([_spread(np.clip((x - mean) / scale, -6, 6)), np.ones(len(y))])
    w = np.zeros(z.shape[1])
    if 0 < y.sum() < len(y):
        keep = np.append(np.full(len(w) - 1, ridge), 1e-6)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            h = (z * (p * (1 - p))[:, None]).T @ z + np.diag(keep)
            step = np.linalg.solve(h, z.T @ (y - p) - keep * w)
            w += step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
    return mean, scale, w


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``most`` rows of each label, by hash of the id; ids whose crc32 has the remainder 1 by 3 are left for testing. An id labelled both ways is good."""
    usable = labels.where((F.crc32(F.col(id_col).cast("string")) % 3 != 1) & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("_y"))
    ids = [usable.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(most) for y in (0, 1)]
    got = docs.select(F.col(id_col).alias("_d"), F.col(text_col).alias("_t")).join(F.broadcast(ids[0].union(ids[1])), F.col("_d") == F.col("_id"))
    rows = sorted(tuple(map(float, r)) for r in got.select("_id", "_y", *features(F.col("_t"))).collect())
    data = np.array(rows, float).reshape(-1, 10)
    return data[:, 2:], data[:, 1]


def evidence(model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Column:
    """Probability of good quality by the text alone, from its features in column ``_f``."""
    mean, scale, w = model
    f = [F.get(F.col("_f"), i) for i in range(len(mean))]
    x = [F.greatest(F.lit(-6.0), F.least(F.lit(6.0), (c - F.lit(float(m))) / F.lit(float(s)))) for c, m, s in zip(f, mean, scale, strict=True)]
    z, k = F.lit(float(w[-1])), len(x)
    for i in range(k):
        inner = F.lit(float(w[i]))
        for j in range(i, k):
            inner = inner + x[j] * F.lit(float(w[k + sum(k - r for r in range(i)) + j - i]))
        z = z + x[i] * inner
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))


def shrinkage(groups: DataFrame, n: str, good: str) -> tuple[float, float]:
    """Rate and strength of a beta prior by the method of moments, from ``n`` documents and ``good`` expected good ones per group.

    The variance of the groups' rates beyond that of sampling gives the strength; where it is none,
    the strength is large.
    """
    g = groups.agg(F.sum(n), F.sum(good), F.sum(F.col(n) * F.col(n)), F.sum(F.col(good) * F.col(good) / F.col(n)), F.count("*")).first()
    total, k = float(g[0] or 0), int(g[4])
    if not total:
        return 0.5, 1.0
    m = min(max(float(g[1]) / total, 1e-4), 1 - 1e-4)
    spread = (float(g[3]) - total * m * m) - (k - 1) * m * (1 - m)
    between = spread / max(1e-9, total - float(g[2]) / total)
    return m, min(1e4, max(1.0, m * (1 - m) / between - 1)) if between > 0 else 1e4


def _odds(p: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (1 - p))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", path_col: str = "lang", label_col: str = "quality", most: int = 4000) -> DataFrame:
    """``(doc_id, site, path, evidence, site_rate, path_rate, score, kept)``: one row per input row.

    Without URLs a document's source is its site and its language the path below it; any two
    columns can be named. Null sites and paths are groups of their own; null and empty texts are
    judged as empty. The classifier is fitted on at most ``most`` labelled rows of each label; counts
    and posteriors cover all rows. Groups are sums that are combined before the shuffle, so a
    source with most rows is no burden. An empty table gives an empty result.
    """
    model = fit(*training_sample(docs, labels, id_col, text_col, label_col, most))
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(site_col).cast("string").alias("site"), F.col(path_col).cast("string").alias("path"), F.array(*[c.cast("double") for c in features(F.col(text_col))]).alias("_f"))
    scored = stored(picked.select("doc_id", "site", "path", evidence(model).alias("evidence")))
    sums = [F.count("*").cast("double").alias("n"), F.sum("evidence").alias("good")]
    paths = stored(scored.groupBy("site", "path").agg(*sums))
    sites = paths.groupBy("site").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    rate, strength = shrinkage(sites, "n", "good")
    _, inner = shrinkage(paths, "n", "good")
    site = sites.select(F.col("site").alias("_s"), ((F.col("good") + rate * strength) / (F.col("n") + strength)).alias("site_rate"))
    by_path = paths.join(site, F.col("site").eqNullSafe(F.col("_s"))).select(F.col("site").alias("_s"), F.col("path").alias("_p"), "n", "good", "site_rate")
    joined = scored.join(by_path, F.col("site").eqNullSafe(F.col("_s")) & F.col("path").eqNullSafe(F.col("_p")))
    others = (F.col("good") - F.col("evidence") + F.col("site_rate") * inner) / (F.col("n") - 1 + inner)
    # The classifier's own odds hold the prior of its sample, which is taken out again.
    z = _odds(others) + _odds(F.col("evidence")) - _odds(F.lit(rate))
    score = 1 / (1 + F.exp(-z))
    out = joined.select("doc_id", "site", "path", "evidence", "site_rate", ((F.col("good") + F.col("site_rate") * inner) / (F.col("n") + inner)).alias("path_rate"), score.alias("score"))
    return out.withColumn("kept", F.col("score") >= KEEP)
