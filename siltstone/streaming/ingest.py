"""Streaming ingest: an extension beside the batch operators, with the same results in the end.

New documents arrive as files; each is taken once by its id, chunked by the same map-only expression
as in a batch, and counted by window with a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltstone.operators import sparse
from siltstone.operators.chunking import chunk_sections
from siltstone.sources.scratch import stored
from siltstone.sources.tables import exists


def new_rows(stream: DataFrame, id_col: str = "id", ts_col: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Each id once; with a time column the state of ids older than the watermark is dropped."""
    if ts_col is None:
        return stream.dropDuplicates([id_col])
    return stream.withWatermark(ts_col, delay).dropDuplicatesWithinWatermark([id_col])


def chunk_stream(sections: DataFrame, strategy: str = "recursive", size: int = 512, overlap: int = 64) -> DataFrame:
    """Chunks of a stream of sections; semantic chunking needs whole sections and is done in batches."""
    if strategy == "semantic":
        raise ValueError("semantic chunking of a stream runs in append_batches")
    return chunk_sections(sections, strategy, size, overlap)


def arrivals(stream: DataFrame, ts_col: str, key_col: str, window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Rows per window and key; late rows beyond the watermark are left out."""
    return stream.withWatermark(ts_col, delay).groupBy(F.window(ts_col, window), key_col).agg(F.count("*").alias("n"))


#: Folders of the ids of a table, by hash.
FOLDERS = 256


def _with_folder(rows: DataFrame, id_col: str) -> DataFrame:
    return rows.withColumn("_folder", F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(FOLDERS)).cast("int"))


def append_new(batch: DataFrame, path: str, number: int, id_col: str = "id") -> None:
    """Append the rows of a batch whose id the table does not have, each id once.

    The ids of the table are kept beside it (``<path>_ids``) in folders by hash, and only the folders of
    the batch's ids are read. Of a batch that broke off and is run again, rows that were written are
    known by the ids of the table's last files: a batch's ids are written after its rows.
    """
    spark, ids = batch.sparkSession, f"{path}_ids"
    rows = _with_folder(batch.dropDuplicates([id_col]), id_col)
    if exists(spark, path):
        known = spark.read.parquet(path).where(F.col("_batch") == number).select(id_col)
        if exists(spark, ids):
            folders = [r[0] for r in rows.select("_folder").distinct().collect()]
            known = known.unionByName(spark.read.parquet(ids).where(F.col("_folder").isin(folders)).select(id_col))
        rows = rows.join(known, id_col, "left_anti")
    rows = stored(rows)
    rows.drop("_folder").withColumn("_batch", F.lit(number)).write.mode("append").partitionBy("_batch").parquet(path)
    spark.read.parquet(path).where(F.col("_batch") == number).transform(_with_folder, id_col).select(id_col, "_folder").write.mode("append").partitionBy("_folder").parquet(ids)


def append_batches(stream: DataFrame, path: str, checkpoint: str, id_col: str = "id", once: bool = True) -> StreamingQuery:
    """``append_new`` for each batch of a stream; one that is run again adds nothing twice."""
    return _each_batch(stream, lambda batch, number: append_new(batch, path, number, id_col), checkpoint, once)


def index_batches(stream: DataFrame, path: str, checkpoint: str, id_col: str = "chunk_id", text_col: str = "text", once: bool = True) -> StreamingQuery:
    """Add a stream of new chunks to the sparse index at ``path``, each batch of the stream as one of the index."""
    return _each_batch(stream, lambda batch, number: sparse.add(batch, path, number, id_col, text_col), checkpoint, once)


def _each_batch(stream: DataFrame, write, checkpoint: str, once: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
