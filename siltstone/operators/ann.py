"""An index for cosine search in large tables: cells of vectors with product-quantised residuals.

Fit. On a bounded sample (``sample`` rows by hash of the id), in one task: centroids of the cells by
k-means on the sphere, and for each of ``parts`` ranges of the dimensions a code book of up to 256
centroids of what is left of a vector when its cell's centroid is taken away.

The number of cells to look into is fitted as well: for some vectors of the sample, it is the least that
holds a share of ``REACHED`` of their ten nearest others. Vectors without any clusters need about half
of all cells, others few.

Build. Every vector goes to the cell of its nearest centroid and is written as one byte a part, beside
the vector itself, in one folder a cell. A cell with very many vectors is several files.

Search. A question looks into its nearest cells, whose folders alone are read. First only
the codes: a vector's score is the question's with the centroid plus, for each part, a number looked up
by the code in a table made once for the question. The best ``refine`` by that score of each question
are compared exactly, for which only their cells' vectors are read. Scores returned are exact cosines.

The exact search over all vectors is ``dense.search``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from siltstone.operators.dense import blocks, emitted, ids_of
from siltstone.operators.nearest import Best, matrix, rounded, unit
from siltstone.operators.sparse import MOST_TERMS, top_k

#: Share of the nearest ten that the cells looked into hold, of the sample's vectors that are compared for it.
REACHED, COMPARED = 0.97, 500
#: Codes scored together for the questions of a cell.
SCORED = 1 << 20


@dataclass
class Books:
    """``centroids`` (cells, dim) and, for each part, its code book; ``cuts`` are where the parts of a vector begin, and its length."""

    centroids: np.ndarray
    books: list[np.ndarray]
    cuts: list[int]
    probes: int = 0

    @property
    def dim(self) -> int:
        return self.cuts[-1]

    def encode(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells and codes (rows, parts) of unit vectors."""
        cells = (rows @ self.centroids.T).argmax(1)
        left = rows - self.centroids[cells]
        return cells, np.stack([_nearest(left[:, a:b], book) for book, a, b in zip(self.books, self.cuts, self.cuts[1:], strict=False)], 1).astype(np.uint8)

    def tables(self, asked: np.ndarray) -> np.ndarray:
        """(questions, parts, 256): what each code of each part adds to a question's score."""
        out = np.zeros((len(asked), len(self.books), 256), np.float32)
        for j, (book, a, b) in enumerate(zip(self.books, self.cuts, self.cuts[1:], strict=False)):
            out[:, j, : len(book)] = asked[:, a:b] @ book.T
        return out


def _nearest(rows: np.ndarray, book: np.ndarray) -> np.ndarray:
    return ((book * book).sum(1) - 2 * rows @ book.T).argmin(1)


def _means(rows: np.ndarray, own: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The mean of each cluster; an empty one keeps its centroid."""
    sums, n = np.zeros_like(centroids), np.bincount(own, minlength=len(centroids))[:, None]
    np.add.at(sums, own, rows)
    return np.where(n > 0, sums / np.maximum(n, 1), centroids)


def fit(rows: np.ndarray, cells: int, parts: int = 16, rounds: int = 12, seed: int = 3) -> Books:
    """Centroids and code books of unit vectors; the number of cells and codes is at most that of the rows."""
    r = np.random.default_rng(seed)
    centroids = rows[r.permutation(len(rows))[:cells]].copy()
    for _ in range(rounds):
        centroids = unit(_means(rows, (rows @ centroids.T).argmax(1), centroids))
    left = rows - centroids[(rows @ centroids.T).argmax(1)]
    cuts = [round(i * rows.shape[1] / parts) for i in range(parts + 1)]
    books = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        part = left[:, a:b]
        book = part[r.permutation(len(part))[:256]].copy()
        for _ in range(rounds):
            book = _means(part, _nearest(part, book), book)
        books.append(book)
    return Books(centroids, books, cuts)


def probes_for(rows: np.ndarray, books: Books) -> int:
    """The least number of nearest cells that hold REACHED of the ten nearest others of the first COMPARED rows."""
    asked = rows[:COMPARED]
    likeness = asked @ rows.T
    likeness[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    nearest = np.argsort(-likeness, 1, kind="stable")[:, : min(10, len(rows) - 1)]
    cells, _ = books.encode(rows)
    place = np.argsort(np.argsort(-(asked @ books.centroids.T), 1, kind="stable"), 1)
    needed = np.sort(np.take_along_axis(place, cells[nearest], 1), axis=None)
    return int(needed[min(len(needed) - 1, math.ceil(REACHED * len(needed)))]) + 1 if needed.size else 1


@dataclass
class AnnIndex:
    """``books``; ``members(cell, chunk_id, code, vector)`` with every vector that can be searched, stored by cell."""

    books: Books | None
    members: DataFrame


_BOOKS = "probes int, cuts array<int>, centroids array<array<double>>, books array<array<array<double>>>"


def _load_books(spark: SparkSession, path: str) -> Books | None:
    row = spark.read.parquet(f"{path}/books").first()
    return Books(np.array(row.centroids), [np.array(b) for b in row.books], list(row.cuts), row.probes) if row else None


def build(vectors: DataFrame, path: str, id_col: str = "chunk_id", vec_col: str = "vector", cells: int | None = None, parts: int = 16, sample: int = 20_000, most_cells: int = 4096, seed: int = 3) -> AnnIndex:
    """Write an index of all vectors below ``path``: about sqrt(n) cells, at most ``most_cells``, if not told how many.

    Null, empty and zero vectors, vectors with null or not finite numbers, those without id, and those of
    another length than most of the sample are left out. ``sample`` vectors are fitted in one task;
    the driver holds the centroids and books only.
    """
    spark = vectors.sparkSession
    named = vectors.select(F.col(id_col).alias("chunk_id"), F.col(vec_col).alias("vector")).where("chunk_id IS NOT NULL AND size(vector) > 0 AND exists(vector, x -> x <> 0)")
    n = named.count()
    wanted = cells or max(1, min(most_cells, math.isqrt(n)))
    some = named.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("chunk_id").cast("string"))), "chunk_id").limit(sample).select("vector")

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b["vector"] for b in batches if b.num_rows]
        lists = pa.concat_arrays(held) if held else None
        if lists is None:
            return
        sizes = np.diff(lists.offsets.to_numpy())
        rows, _ = matrix(lists, int(np.bincount(sizes).argmax()))
        if len(rows):
            got = fit(rows, max(1, min(wanted, len(rows) // 4)), min(parts, rows.shape[1]), seed=seed)
            yield pa.RecordBatch.from_arrays([pa.array([probes_for(rows, got)], pa.int32()), pa.array([got.cuts], pa.list_(pa.int32())), pa.array([got.centroids.tolist()]), pa.array([[b.tolist() for b in got.books]])], ["probes", "cuts", "centroids", "books"])

    some.coalesce(1).mapInArrow(fitted, _BOOKS).write.mode("overwrite").parquet(f"{path}/books")
    books, kind = _load_books(spark, path), vectors.schema[vec_col].dataType
    sent = spark.sparkContext.broadcast(books)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if sent.value is None:
                return
            rows, at = matrix(batch["vector"], sent.value.dim)
            if len(at):
                cells, codes = sent.value.encode(rows)
                kept = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([kept["chunk_id"], pa.array([c.tobytes() for c in codes], pa.binary()), kept["vector"], pa.array(cells.astype(np.int32))], ["chunk_id", "code", "vector", "cell"])

    members = named.mapInArrow(coded, f"chunk_id {vectors.schema[id_col].dataType.simpleString()}, code binary, vector {kind.simpleString()}, cell int")
    members.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/members")
    return load(spark, path, members.schema)


def load(spark: SparkSession, path: str, schema=None) -> AnnIndex:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return AnnIndex(_load_books(spark, path), reader.parquet(f"{path}/members"))


def search(index: AnnIndex, queries: DataFrame, k: int = 10, probes: int | None = None, refine: int | None = None, query_col: str = "query_id", query_vec_col: str = "vector", digits: int = 6) -> DataFrame:
    """``query_id, chunk_id, score, rank`` as ``dense.search``, among the ``refine`` best by code (50 k) of each question's ``probes`` nearest cells.

    Not told, ``probes`` is the number fitted. Ids must differ. Questions are answered in
    blocks, whose vectors and tables of codes go to all tasks. Of each question, a task keeps ``refine`` rows.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    books, members, spark = index.books, index.members, index.members.sparkSession
    kinds = [queries.schema[query_col].dataType, members.schema["chunk_id"].dataType]
    types = [to_arrow_type(t) for t in kinds]
    schema = f"query_id {kinds[0].simpleString()}, chunk_id {kinds[1].simpleString()}, score double"
    kept = refine or 50 * k
    if books is None:
        return top_k(spark.createDataFrame([], schema), k)
    count = min(len(books.centroids), probes or books.probes)
    out = None
    for names, groups in blocks(queries, query_col, query_vec_col):
        if books.dim not in groups:
            continue
        at, asked = groups[books.dim]
        near = asked @ books.centroids.T
        probed = np.argsort(-near, axis=1, kind="stable")[:, :count]
        by_cell = {int(c): np.flatnonzero((probed == c).any(1)) for c in np.unique(probed)}
        sent = spark.sparkContext.broadcast((names, at, asked, near.astype(np.float32), books, by_cell))

        def scored(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            _, at, asked, near, books, by_cell = sent.value
            tables, best = books.tables(asked), Best(len(at), kept)
            for batch in batches:
                cells, ids = batch["cell"].to_numpy(), ids_of(batch["chunk_id"])
                codes = np.frombuffer(b"".join(batch["code"].to_pylist()), np.uint8).reshape(len(ids), -1)
                for c in np.unique(cells):
                    own, rows = by_cell[int(c)], np.flatnonzero(cells == c)
                    width = max(1, SCORED // len(own))
                    for i in range(0, len(rows), width):
                        some = rows[i : i + width]
                        scores = near[own, c][:, None] + sum(tables[own, j][:, codes[some, j]] for j in range(codes.shape[1]))
                        best.add(own, scores.astype(float), ids[some])
            yield from emitted(best, list(range(len(at))), np.arange(len(at)), [pa.int32(), types[1]])

        cells = members.where(F.col("cell").isin(*by_cell))
        rough = top_k(cells.select("cell", "chunk_id", "code").mapInArrow(scored, f"query_id int, chunk_id {kinds[1].simpleString()}, score double"), kept).select("query_id", "chunk_id")
        rough = F.broadcast(rough) if len(at) * kept <= MOST_TERMS else rough
        pairs = cells.select("chunk_id", "vector").join(rough, "chunk_id")

        def exact(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, at, asked, _, books, _ = sent.value
            for batch in batches:
                rows, _ = matrix(batch["vector"], books.dim)
                own = asked[batch["query_id"].to_numpy()]
                ids = pa.array([names[at[q]] for q in batch["query_id"].to_pylist()], types[0])
                yield pa.RecordBatch.from_arrays([ids, batch["chunk_id"], pa.array(rounded((own * rows).sum(1), digits))], ["query_id", "chunk_id", "score"])

        found = pairs.select("query_id", "chunk_id", "vector").mapInArrow(exact, schema)
        out = found if out is None else out.unionByName(found)
    return top_k(out if out is not None else spark.createDataFrame([], schema), k)
