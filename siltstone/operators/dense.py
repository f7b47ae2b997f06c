"""Nearest neighbours of a batch of questions by cosine, exact over all vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from siltstone.operators.nearest import CHUNK, Best, matrix, rounded
from siltstone.operators.sparse import top_k
from siltstone.sources.scratch import stored

#: Question vectors sent to every executor at once; larger batches are answered in blocks of this size.
BLOCK = 4096


def blocks(queries: DataFrame, query_col: str, vec_col: str) -> Iterator[tuple[list, dict[int, tuple[np.ndarray, np.ndarray]]]]:
    """Blocks of at most about BLOCK questions: their ids, and for each length of vector (places in the ids, unit vectors).

    Null vectors, and those with null or not finite numbers, ask nothing.
    """
    asked = queries.select(F.col(query_col).alias("query_id"), F.col(vec_col).alias("vector")).where("size(vector) > 0")
    n = -(-asked.count() // BLOCK)
    if n > 1:
        asked = stored(asked)
    for b in range(n):
        table = (asked if n == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == b)).toArrow()
        lists = table["vector"].combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        found = {}
        for dim in set(np.diff(lists.offsets.to_numpy()).tolist()):
            rows, at = matrix(lists, dim)
            if len(at):
                found[dim] = (at, rows)
        if found:
            yield table["query_id"].to_pylist(), found


def ids_of(column: pa.Array) -> np.ndarray:
    """Ids as numpy values that sort as Spark sorts them."""
    return column.to_numpy(zero_copy_only=False) if pa.types.is_integer(column.type) and not column.null_count else np.array(column.to_pylist(), object)


def emitted(best: Best, names: list, at: np.ndarray, types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """The rows ``query_id, chunk_id, score`` of the best of some questions."""
    for q, scores, ids in best.rows():
        yield pa.RecordBatch.from_arrays([pa.array([names[at[q]]] * len(ids), types[0]), pa.array(ids.tolist(), types[1]), pa.array(scores)], ["query_id", "chunk_id", "score"])


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "chunk_id", vec_col: str = "vector", query_col: str = "query_id", query_vec_col: str = "vector", digits: int = 6) -> DataFrame:
    """``query_id, chunk_id, score, rank``; score is the cosine, ties go to the smaller chunk_id.

    The questions go to all tasks in blocks of at most BLOCK vectors. A task compares CHUNK vectors with
    the block by one matrix product and keeps the k best of each question, so what is shuffled is k
    rows of a question and task, and what is held does not grow with the vectors. Vectors of another
    length, null, or with null or not finite numbers are left out; a zero vector's cosine is 0.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    spark = vectors.sparkSession
    kinds = [queries.schema[query_col].dataType, vectors.schema[id_col].dataType]
    schema = f"query_id {kinds[0].simpleString()}, chunk_id {kinds[1].simpleString()}, score double"
    types = [to_arrow_type(t) for t in kinds]
    left = vectors.select(F.col(id_col).alias("chunk_id"), F.col(vec_col).alias("vector")).where("chunk_id IS NOT NULL AND size(vector) > 0")
    out = spark.createDataFrame([], schema)
    for names, groups in blocks(queries, query_col, query_vec_col):
        sent = spark.sparkContext.broadcast((names, groups))

        def compare(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, groups = sent.value
            best = {dim: Best(len(at), k) for dim, (at, _) in groups.items()}
            for batch in batches:
                for dim, (_, asked) in groups.items():
                    rows, at = matrix(batch["vector"], dim)
                    ids = ids_of(batch["chunk_id"].take(pa.array(at)))
                    for i in range(0, len(at), CHUNK):
                        best[dim].add(np.arange(len(asked)), rounded(asked @ rows[i : i + CHUNK].T, digits), ids[i : i + CHUNK])
            for dim, b in best.items():
                yield from emitted(b, names, groups[dim][0], types)

        out = out.unionByName(left.mapInArrow(compare, schema))
    return top_k(out, k)
