"""Scoring of (question, text) pairs by a model: batches by length for any model, and a small fitted one.

``model_scorer`` loads a model once a task and calls it with batches of pairs of like length, the way
models that pad their input want it. ``fit`` learns a logistic regression over what a pair shares (terms,
runs of two and three, the longest run, and lengths) from all labelled pairs, by sums that tasks work out.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators.rerank import Scorer
from siltstone.sources.scratch import stored

_TERM = re.compile("[a-z0-9]+")
#: (questions, texts) -> scores
Pairs = Callable[[list[str], list[str]], np.ndarray]
FEATURES = ("terms", "pairs", "triples", "longest run", "question", "text", "one")


def model_scorer(load: Callable[[], Pairs], size: int = 32) -> Scorer:
    """``load()`` is called once a task; its result scores ``size`` pairs at once, sorted by length. A pair with a null scores null."""

    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for questions, texts in batches:
            out = np.full(len(questions), np.nan)
            known = np.flatnonzero((questions.notna() & texts.notna()).to_numpy())
            length = (questions.str.len() + texts.str.len()).to_numpy()
            known = known[np.argsort(length[known], kind="stable")]
            for i in range(0, len(known), size):
                some = known[i : i + size]
                out[some] = model(questions.iloc[some].tolist(), texts.iloc[some].tolist())
            yield pd.Series(out).astype(object).where(~np.isnan(out), None)

    score.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return F.pandas_udf(score, "double")


def _longest_run(question: list[int], places: dict[int, list[int]]) -> int:
    """Terms of the longest run of the question that stands in the text; ``places`` has where each term stands."""
    best, ends = 0, {}
    for term in question:
        ends = {at: ends.get(at - 1, 0) + 1 for at in places.get(term, ())}
        best = max([best, *ends.values()])
    return best


def features(questions: list[str], texts: list[str]) -> np.ndarray:
    """(pairs, FEATURES); shares are of the question's."""
    out = np.zeros((len(questions), len(FEATURES)))
    for row, question, text in zip(out, questions, texts, strict=True):
        q, t = _TERM.findall(question.lower()), _TERM.findall(text.lower())
        for n in range(3):
            asked = set(zip(*(q[i:] for i in range(n + 1)), strict=False))
            row[n] = len(asked & set(zip(*(t[i:] for i in range(n + 1)), strict=False))) / max(1, len(asked))
        places: dict[str, list[int]] = {}
        wanted = set(q)
        for i, term in enumerate(t):
            if term in wanted:
                places.setdefault(term, []).append(i)
        row[3] = _longest_run(q, places) / max(1, len(q))
        row[4:] = np.log1p(len(q)), np.log1p(len(t)), 1.0
    return out


@dataclass
class Logistic:
    """Weights of the features, after they are scaled."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def __call__(self, questions: list[str], texts: list[str]) -> np.ndarray:
        return np.round(1 / (1 + np.exp(-((features(questions, texts) - self.mean) / self.scale) @ self.weights)), 9)

    def scorer(self) -> Scorer:
        return model_scorer(lambda: self)


def _sums(rows: DataFrame, values: Callable[[np.ndarray, np.ndarray], list[np.ndarray]]) -> np.ndarray:
    """Sums over all rows of ``values(features by column, labels)``, in whole steps of 2^-40, so that no order of the rows changes them."""
    names = [f"x{i}" for i in range(len(FEATURES))]

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: list[int] = []
        for b in batches:
            steps = [np.rint(v * 2.0**40) for v in values(b[names].to_numpy(float).T, b["label"].to_numpy(float))]
            high = [np.floor(v / 2.0**32) for v in steps]
            found = [(int(h.astype(np.int64).sum()) << 32) + int((v - h * 2.0**32).astype(np.int64).sum()) for v, h in zip(steps, high, strict=True)]
            total = [t + f for t, f in zip(total or [0] * len(found), found, strict=True)]
        if total:
            yield pd.DataFrame({"total": [[str(t) for t in total]]})

    parts = rows.mapInPandas(summed, "total array<string>").collect()  # a few numbers a task
    return np.array([sum(map(int, column)) / 2**40 for column in zip(*(r["total"] for r in parts), strict=True)])


def fit(pairs: DataFrame, penalty: float = 1.0) -> Logistic:
    """Fitted to all pairs of ``question, text, label`` (0 or 1; others and nulls are left out).

    The features of a pair are stored once; the mean, the spread and each of Newton's steps are sums
    over all of them, so the driver holds a few numbers, however many pairs there are.
    """
    known = pairs.where("label IN (0, 1) AND question IS NOT NULL AND text IS NOT NULL").select("question", "text", F.col("label").cast("int").alias("label"))
    names = [f"x{i}" for i in range(len(FEATURES))]

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame(features(b["question"].tolist(), b["text"].tolist()), columns=names).assign(label=b["label"].to_numpy())

    rows = stored(known.repartition("question", "text").mapInPandas(measured, ", ".join(f"{x} double" for x in names) + ", label int"))
    n = dict.fromkeys((0, 1), 0) | {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if not all(n.values()):
        raise ValueError("both labels are needed")
    size = len(names)
    mean = _sums(rows, lambda x, y: list(x)) / sum(n.values())
    mean[-1] = 0.0
    scale = np.sqrt(_sums(rows, lambda x, y: [(v - m) ** 2 for v, m in zip(x, mean, strict=True)]) / sum(n.values()))
    scale[scale < 1e-9] = 1.0
    each = [sum(n.values()) / 2 / n[label] for label in (0, 1)]  # both labels weigh alike
    upper, w = np.triu_indices(size), np.zeros(size)

    def slopes(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        x = [(v - m) / s for v, m, s in zip(x, mean, scale, strict=True)]
        p = 1 / (1 + np.exp(-sum(v * u for v, u in zip(x, w, strict=True))))
        own = np.where(y == 1, each[1], each[0])
        return [own * (p - y) * v for v in x] + [own * p * (1 - p) * x[i] * x[j] for i, j in zip(*upper, strict=True)]

    for _ in range(30):
        found = _sums(rows, slopes)
        curve = np.zeros((size, size))
        curve[upper] = found[size:]
        curve = np.triu(curve) + np.triu(curve, 1).T
        step = np.linalg.solve(curve + penalty * np.eye(size), found[:size] + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return Logistic(mean, scale, w)
