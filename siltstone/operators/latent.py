"""A fitted embedder: TF-IDF reduced by a randomised singular value decomposition of all chunks.

Fit. The vocabulary is the ``terms`` terms of most chunks. Chunks become sparse unit rows x of X once.
A random matrix Q of a few more columns than dimensions is then improved in rounds: Q becomes X'XQ, made
orthonormal. In a round each task adds up its rows' x'(xQ) for all terms, a matrix whose size is that
of Q whatever the number of chunks; the tasks' matrices are added in two steps, in pieces of the terms.
Last, the small matrix Q'X'XQ gives the directions of most weight within Q. The driver and every task
hold ``terms`` times (``dims`` + EXTRA) numbers.

Use. A text's vector is its row times the directions, each divided by the root of its weight, at length
1; a text without known terms has the zero vector. The first directions tell what nearly all chunks
share: left at their weight they drown the others, the more so the more chunks there are. One pass
without a shuffle.

Rows are multiplied a few at a time as a dense matrix over the terms that these few have.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from siltstone.sources.scratch import stored

EXTRA = 16
#: Pieces of the terms, and groups of tasks, in which matrices are added.
PIECES, GROUPS = 32, 64
#: Terms of chunks whose rows are multiplied at once, and most of these rows; counts that a task holds before it sends them on.
AT_ONCE, MOST_ROWS, HELD = 1 << 14, 64, 300_000
#: Directions with less than this share of the largest weight are noise and are left out.
LEAST = 1e-12
_TERM = re.compile("[a-z0-9]+")


def _lowered(rows: DataFrame, text_col: str) -> DataFrame:
    return rows.select(F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text"))


def document_counts(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """``term, df``: chunks that hold a term; each task adds up before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def send() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["term", "df"])
            seen.clear()
            return out

        for batch in batches:
            for text in batch["text"]:
                seen.update(set(_TERM.findall(text.as_py())))
                if len(seen) > HELD:
                    yield send()
        yield send()

    return _lowered(rows, text_col).mapInArrow(count, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))


@dataclass
class Rows:
    """Sparse rows: where each ends, the terms' numbers and their weights."""

    ends: np.ndarray
    at: np.ndarray
    weights: np.ndarray

    def dense(self, wide: int) -> tuple[np.ndarray, np.ndarray]:
        """The terms of these rows, and the rows as a matrix over them alone."""
        known = np.zeros(wide, bool)
        known[self.at] = True
        terms = np.flatnonzero(known)
        place = np.empty(wide, np.int64)
        place[terms] = np.arange(len(terms))
        out = np.zeros((len(self.ends), len(terms)), np.float32)
        out[np.repeat(np.arange(len(self.ends)), np.diff(self.ends, prepend=0)), place[self.at]] = self.weights
        return terms, out

    def times(self, matrix: np.ndarray) -> np.ndarray:
        terms, rows = self.dense(len(matrix))
        return (rows @ matrix[terms].astype(np.float32, copy=False)).astype(float)

    def add_squared(self, matrix: np.ndarray, out: np.ndarray) -> None:
        """Add these rows, transposed, times the rows times ``matrix`` to ``out``."""
        if len(self.at):
            terms, rows = self.dense(len(matrix))
            out[terms] += rows.T @ (rows @ matrix[terms])


def sparse_rows(texts: list[str], number: dict[str, int], idf: np.ndarray) -> Rows:
    """Unit rows of (1 + log tf) idf over the known terms."""
    counts = [Counter(_TERM.findall(text)) for text in texts]
    at = np.fromiter((number.get(t, -1) for t in chain.from_iterable(counts)), np.int64)
    tf = np.fromiter(chain.from_iterable(c.values() for c in counts), float, len(at))
    row, known = np.repeat(np.arange(len(texts)), [len(c) for c in counts]), at >= 0
    at, tf, row = at[known], tf[known], row[known]
    weights = (1 + np.log(tf)) * idf[at]
    size = np.sqrt(np.bincount(row, weights * weights, len(texts)))
    return Rows(np.cumsum(np.bincount(row, minlength=len(texts))), at, weights / size[row])


@dataclass
class Latent:
    """``terms`` with their ``idf`` and ``directions`` (terms, dims) of unit length, and the ``scale`` (dims) of each; calling it embeds, as ``retrieval.Embedder``."""

    terms: list[str]
    idf: np.ndarray
    directions: np.ndarray
    scale: np.ndarray
    _sent: Broadcast | None = field(default=None, repr=False)

    def vectors(self, texts: list[str]) -> np.ndarray:
        """Unit vectors of lower-cased texts."""
        return _unit(sparse_rows(texts, {t: i for i, t in enumerate(self.terms)}, self.idf).times(self.directions * self.scale))

    def __call__(self, rows: DataFrame, id_cols: list[str], text_col: str = "text") -> DataFrame:
        spark = rows.sparkSession
        if self._sent is None:
            self._sent = spark.sparkContext.broadcast((self.terms, self.idf, (self.directions * self.scale).astype(np.float32)))
        sent, kinds = self._sent, [rows.schema[c].dataType for c in id_cols]
        types = [to_arrow_type(k) for k in kinds]

        def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            terms, idf, directions = sent.value
            number = {t: i for i, t in enumerate(terms)}
            for batch in batches:
                texts = batch["_text"].to_pylist()
                # few texts at once, so that the rows of one product stay small
                for i in range(0, len(texts), 64):
                    unit = _unit(sparse_rows(texts[i : i + 64], number, idf).times(directions))
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(unit) + 1, dtype=np.int32) * unit.shape[1]), pa.array(unit.ravel()))
                    yield pa.RecordBatch.from_arrays([*(batch[f"_{n}"].slice(i, len(unit)).cast(t) for n, t in enumerate(types)), lists], [*id_cols, "vector"])

        named = rows.select(*(F.col(c).alias(f"_{n}") for n, c in enumerate(id_cols)), F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("_text"))
        return named.mapInArrow(embed, ", ".join([*(f"`{c}` {k.simpleString()}" for c, k in zip(id_cols, kinds, strict=True)), "vector array<double>"]))


def _unit(raw: np.ndarray) -> np.ndarray:
    size = np.sqrt((raw * raw).sum(1, keepdims=True))
    return np.divide(raw, size, out=np.zeros_like(raw), where=size > 0)


def _added(rows: DataFrame, wide: int, columns: int, q: Broadcast) -> np.ndarray:
    """X'XQ, added up by tasks, then by groups of tasks, then by pieces of the terms."""
    cuts = [round(i * wide / PIECES) for i in range(PIECES + 1)]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((wide, columns))
        for batch in batches:
            offsets, at, weights = batch["at"].offsets.to_numpy(), batch["at"].values.to_numpy(), batch["weights"].values.to_numpy()
            i = 0
            while i < batch.num_rows:
                j = min(i + MOST_ROWS, max(i + 1, int(np.searchsorted(offsets, offsets[i] + AT_ONCE, "right")) - 1), batch.num_rows)
                some = Rows(offsets[i + 1 : j + 1] - offsets[i], at[offsets[i] : offsets[j]], weights[offsets[i] : offsets[j]])
                some.add_squared(q.value, out)
                i = j
        group = TaskContext.get().partitionId() % GROUPS
        yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array([group] * PIECES, pa.int32()), pa.array([out[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())], ["piece", "part", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["piece", "part", "sums"])
        for batch in batches:
            for piece, part, sums in zip(batch["piece"].to_pylist(), batch["part"].to_pylist(), batch["sums"], strict=True):
                if (piece, part) != key:
                    if key is not None:
                        yield row()
                    key, total = (piece, part), np.zeros(len(sums.as_buffer()) // 8)
                total += np.frombuffer(sums.as_buffer())
        if key is not None:
            yield row()

    kind = "piece int, part int, sums binary"
    by_group = rows.mapInArrow(multiply, kind).repartition("piece", "part").sortWithinPartitions("piece", "part").mapInArrow(add, kind)
    by_piece = by_group.withColumn("part", F.lit(0)).repartition("piece").sortWithinPartitions("piece", "part").mapInArrow(add, kind)
    found = {r["piece"]: np.frombuffer(r["sums"]) for r in by_piece.select("piece", "sums").collect()}
    return np.concatenate([found[p] for p in range(PIECES) if p in found]).reshape(wide, columns)


def fit(chunks: DataFrame, text_col: str = "text", dims: int = 128, terms: int = 30_000, rounds: int = 2, seed: int = 5) -> Latent:
    """An embedder fitted to all chunks; at most ``terms`` terms, those of most chunks (ties in code-point order)."""
    spark = chunks.sparkSession
    counted = document_counts(chunks, text_col)
    top = counted.orderBy(F.col("df").desc(), "term").limit(terms).toArrow()
    names = top["term"].to_pylist()
    n = chunks.count()
    idf = np.log((1 + n) / (1 + np.array(top["df"].to_pylist(), float))) + 1
    dims = min(dims, len(names))
    if not dims:
        return Latent([], np.zeros(0), np.zeros((0, 1)), np.ones(1))
    sent = spark.sparkContext.broadcast((names, idf))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, idf = sent.value
        number = {t: i for i, t in enumerate(names)}
        for batch in batches:
            rows = sparse_rows(batch["text"].to_pylist(), number, idf)
            offsets = pa.array(np.append(0, rows.ends).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(rows.at.astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(rows.weights))], ["at", "weights"])

    rows = stored(_lowered(chunks, text_col).mapInArrow(encode, "at array<int>, weights array<double>"))
    columns = min(len(names), dims + EXTRA)
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(names), columns)))[0]
    for last in [False] * rounds + [True]:
        now = spark.sparkContext.broadcast(q.astype(np.float32))
        product = _added(rows, len(names), columns, now)
        now.unpersist()
        if last:
            weight, turn = np.linalg.eigh(q.T @ product)
            top = np.argsort(-weight)[:dims]
            real = weight[top] > LEAST * weight.max()
            return Latent(names, idf, q @ turn[:, top], np.where(real, 1 / np.sqrt(np.where(real, weight[top], 1)), 0))
        q = np.linalg.qr(product)[0]
    raise AssertionError


def save(model: Latent, spark: SparkSession, path: str) -> None:
    """A row a term; row -1 has the scale."""
    rows = [(-1, None, None, model.scale.tolist())] + [(i, t, float(w), d.tolist()) for i, (t, w, d) in enumerate(zip(model.terms, model.idf, model.directions, strict=True))]
    spark.createDataFrame(rows, "no int, term string, idf double, direction array<double>").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Latent:
    scale, *rows = spark.read.parquet(path).orderBy("no").collect()
    return Latent([r.term for r in rows], np.array([r.idf for r in rows]), np.array([r.direction for r in rows]), np.array(scale.direction))
