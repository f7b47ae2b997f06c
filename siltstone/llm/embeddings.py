"""Near-duplicate embeddings: random-hyperplane sign hashing, exact cosine, components.

Each of several tables hashes a vector to the signs of its products with random hyperplanes; vectors
that share a table's code are compared exactly. A pair that meets in several tables is counted in the
first of them only, which each task finds from the codes it works out again from the vectors, so that
no list of pairs is ever made: a bucket gives a number of links per vector and a spanning forest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import connected_components, cut, partitions, split_buckets, stream_groups

#: Most vectors of one part of a bucket; a block compares two parts at once.
PART = 2048


def plan_tables(n: int, threshold: float, bucket: int = 48, miss: float = 1e-5) -> tuple[int, int]:
    """Bits of a code and number of tables: random codes leave about ``bucket`` vectors a bucket, and
    a pair at the threshold is missed by all tables with probability ``miss`` at most (a closer pair
    far more seldom)."""
    bits = max(4, min(30, math.ceil(math.log2(max(2, n) / bucket))))
    p = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - p))


@lru_cache(8)
def _planes(dim: int, bits: int, tables: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).normal(size=(dim, bits * tables))


def codes(unit: np.ndarray, bits: int, tables: int, seed: int = 13) -> np.ndarray:
    """(vectors, tables) int32 codes; the same numbers wherever they are worked out again."""
    out = np.empty((len(unit), tables), np.int32)
    for at in range(0, len(unit), 4096):
        signs = (unit[at : at + 4096] @ _planes(unit.shape[1], bits, tables, seed)) > 0
        out[at : at + 4096] = signs.reshape(-1, tables, bits) @ (1 << np.arange(bits))
    return out


def _unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    v /= np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def vector_classes(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(rep, n, vec)``: one row per distinct usable vector, with its least id and its number of rows."""
    good = F.col("vec").isNotNull() & (F.size("vec") > 0) & F.forall("vec", lambda x: x.isNotNull() & (F.abs(x) < F.lit(math.inf))) & F.exists("vec", lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(vec_col).cast("array<double>").alias("vec")).where(F.col("_id").isNotNull() & good).groupBy("vec").agg(F.min("_id").alias("rep"), F.count("*").alias("n"))


def links(classes: DataFrame, threshold: float = 0.9, single: bool = False) -> DataFrame:
    """Checkpointed ``(a, b, n)``: with b null, n more links for vector a; else an edge of a forest that connects all linked vectors.

    ``classes`` has ``rep, n, vec``. A link's weight is the number of rows of the other class. With
    ``single`` the numbers are known to fit 4 bytes and are sent so; products are always double.
    """
    spark = classes.sparkSession
    bits, tables = plan_tables(classes.count(), threshold)
    kind = np.float32 if single else np.float64

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, rows in _by_dim(b.column(2), kind):
                unit = _unit(rows[1])
                found = codes(unit, bits, tables)
                rep, n = b.column(0).to_numpy()[rows[0]], b.column(1).to_numpy()[rows[0]]
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rep), pa.array(n), pa.array([x.tobytes() for x in rows[1]], pa.binary()), pa.array(np.full(len(rep), dim, np.int32)), pa.array(np.full(len(rep), t, np.int32)), pa.array(found[:, t])],
                        names=["rep", "n", "vec", "dim", "t", "code"],
                    )

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in stream_groups(batches, keys):
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            rep, weight, part, table = (t[c].to_numpy() for c in ("rep", "n", "part", "t"))
            vec = t["vec"].combine_chunks()
            for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                if z - a < 2:
                    continue
                raw = b"".join(vec.slice(a, z - a).to_pylist())
                unit = _unit(np.frombuffer(raw, kind).reshape(z - a, -1))
                got = _block(unit, part[a:z], int(table[a]), bits, tables, threshold)
                if len(got[0]):
                    out.append(_digest(got, rep[a:z], weight[a:z]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) if i != 1 else _nullable(np.concatenate(c)) for i, c in enumerate(zip(*out, strict=True))], names=["a", "b", "n"])

    keys = ["dim", "t", "code", "lo", "hi"]
    rows = classes.select("rep", "n", "vec").mapInArrow(hashed, "rep long, n long, vec binary, dim int, t int, code int")
    blocks = split_buckets(rows, ["dim", "t", "code"], PART, F.col("rep"))
    dealt = blocks.select("rep", "n", "vec", "part", *keys).repartition(partitions(spark), *keys).sortWithinPartitions(*keys)
    return cut(dealt.mapInArrow(compared, "a long, b long, n long"))


def _by_dim(column: pa.Array, kind: type) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray]]]:
    """Rows and vectors by length."""
    sizes = np.diff(column.offsets.to_numpy())
    flat, starts = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    for dim in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == dim)
        yield dim, (at, flat[starts[at][:, None] + np.arange(dim)].reshape(len(at), dim).astype(kind))


def _nullable(b: np.ndarray) -> pa.Array:
    return pa.array(b, mask=b == np.iinfo(np.int64).min)


def _block(unit: np.ndarray, part: np.ndarray, table: int, bits: int, tables: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs (i, j) of a block that meet in no earlier table; across parts only where it holds two."""
    found = codes(unit, bits, tables)[:, :table]
    two = part.min() != part.max()
    left, right = [], []
    for at in range(0, len(unit), 1024):
        i, j = np.nonzero(unit[at : at + 1024] @ unit.T >= threshold)
        i += at
        ok = (i < j) & ((part[i] != part[j]) | (not two))
        i, j = i[ok], j[ok]
        for k in range(0, len(i), 1 << 18):
            p, q = i[k : k + (1 << 18)], j[k : k + (1 << 18)]
            new = np.ones(len(p), bool)
            for c in range(table):
                new &= found[p, c] != found[q, c]
            left.append(p[new])
            right.append(q[new])
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, int), np.zeros(0, int))


def _digest(pairs: tuple[np.ndarray, np.ndarray], rep: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of each vector, and a spanning forest of the pairs."""
    i, j = pairs
    n = np.bincount(i, weight[j], len(rep)) + np.bincount(j, weight[i], len(rep))
    root = np.arange(len(rep))
    while True:  # least label among neighbours, with shortcuts
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        low = low[low]
        if (low == root).all():
            break
        root = low
    some, child = np.flatnonzero(n), np.flatnonzero(root != np.arange(len(rep)))
    none = np.full(len(some), np.iinfo(np.int64).min)
    return np.append(rep[some], rep[child]), np.append(none, rep[root[child]]), np.append(n[some].astype(np.int64), np.zeros(len(child), np.int64))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """``(id_col, n_links long, component_id long, kept boolean)``: one row per input row.

    Links are pairs of rows with cosine >= threshold in double precision. Vectors that are null,
    empty, zero or hold null or non-finite components, vectors of different lengths, and rows with a
    null id, link with nothing. Equal vectors are one class and searched once, so a vector that fills
    a third of the table costs one row; its rows link with each other and with all rows of linked
    classes. component_id is the least id reachable, kept marks the row that has it. An empty table
    gives an empty result; other columns are not read.
    """
    classes = cut(vector_classes(vectors, id_col, vec_col))
    found = links(classes, threshold, vectors.schema[vec_col].dataType.simpleString() == "array<float>")
    more = found.where("b IS NULL").groupBy("a").agg(F.sum("n").alias("_more"))
    part = connected_components(found.where("b IS NOT NULL").select("a", "b"))
    labelled = classes.join(more, F.col("rep") == F.col("a"), "left").join(part, F.col("rep") == F.col("node"), "left")
    labelled = labelled.select(F.col("vec").alias("_vec"), (F.col("n") - 1 + F.coalesce("_more", F.lit(0))).alias("_links"), F.coalesce("component", "rep").alias("_component"))
    rows = vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(vec_col).cast("array<double>").alias("_v"))
    joined = rows.join(labelled, (F.col("_v") == F.col("_vec")) & F.col("_id").isNotNull(), "left")
    component = F.coalesce("_component", "_id")
    return joined.select(F.col("_id").alias(id_col), F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("_id") == component, F.lit(False)).alias("kept"))
