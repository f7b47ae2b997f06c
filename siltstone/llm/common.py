"""Helpers shared by the corpus operators: checkpoints, components, bucket streams."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table that may be broadcast; a larger one is joined by a shuffle.
MOST_BROADCAST = 500_000
#: Edges that one task joins to components; a larger graph is first made smaller by all tasks.
EDGES = 1 << 18
#: The characters that separate words in every contract of this package.
WORD = r"[^\x20\x09-\x0D]+"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder of the session; set one of our own only where none is set and one process does all work."""
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="siltstone-checkpoint-"))


def release(spark: SparkSession) -> None:
    """Have the driver forget what nothing refers to any more.

    Spark deletes shuffle files, broadcasts and checkpoints only once the driver's collector finds
    their owners gone. Iterative jobs leave little garbage on a large heap, so that files of steps long
    done would stay on the executors' disks, and the driver's heap would grow.
    """
    gc.collect()
    spark._jvm.System.gc()


def cut(df: DataFrame) -> DataFrame:
    """Compute once, keep in the shared checkpoint folder, forget the lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    done = df.checkpoint()
    release(df.sparkSession)
    return done


#: Paths of the tables that ``stored`` made since the innermost ``only`` began.
_made: ContextVar[dict[str, DataFrame] | None] = ContextVar("made", default=None)


def stored(df: DataFrame) -> DataFrame:
    """As ``cut``, for larger tables: a compressed table in the checkpoint folder, of which later steps read only the columns they need. It goes by ``drop``, or when the driver ends."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    path = f"{base.rstrip('/')}/siltstone-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    release(spark)
    done = spark.read.schema(df.schema).parquet(path)
    if _made.get() is not None:
        _made.get()[path] = done
    done.stored_at = path
    return done


def drop(*tables: DataFrame) -> None:
    """Delete ``stored`` tables that no later step reads."""
    for df in tables:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def only(make: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``make()`` returns, stored; all others that it stored go, so it must hand none of them on."""
    before = _made.get()
    token = _made.set({})
    try:
        done = make()
        if getattr(done, "stored_at", None) not in _made.get():
            done = stored(done)
        made = _made.get()
    finally:
        _made.reset(token)
    drop(*[df for path, df in made.items() if path != done.stored_at])
    if before is not None:
        before[done.stored_at] = done
    return done


def small(df: DataFrame, weight: Column | None = None) -> DataFrame:
    """A table on disk, marked for broadcast if it has few rows, or little weight of 4 bytes each."""
    n = df.agg(F.count("*") + F.coalesce(F.sum(weight if weight is not None else F.lit(0)), F.lit(0))).first()[0]
    return F.broadcast(df) if n <= MOST_BROADCAST * (1 if weight is None else 4) else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8; bytes.split() separates at exactly these six characters."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def _least(edges: DataFrame, both: bool) -> DataFrame:
    """For each node the least of its neighbours (of the smaller ones only unless both) and itself."""
    if both:
        edges = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return edges.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(node, component)`` of all nodes of some edges ``(a, b)``."""
    held = list(batches)
    if not held:
        return
    ends = np.concatenate([b[c].to_numpy() for c in ("a", "b") for b in held])
    nodes, at = np.unique(ends, return_inverse=True)  # in order, so that the least place is the least node
    x, y = at.reshape(2, -1)
    root = np.arange(len(nodes))
    while len(x):
        rx, ry = root[x], root[y]
        np.minimum.at(root, np.maximum(rx, ry), np.minimum(rx, ry))
        while (root != root[root]).any():
            root = root[root]
        apart = root[x] != root[y]
        x, y = x[apart], y[apart]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["node", "component"])


def connected_components(edges: DataFrame, max_rounds: int = 60, few: int = EDGES) -> DataFrame:
    """Components of an undirected graph by alternating large-star and small-star rounds.

    ``edges`` has two long columns, taken by position. Returns ``(node, component)`` for every node
    that has an edge to another; component is the least node reachable. Self loops, repeated edges
    and an empty graph are allowed. A star rewrites the edges of a node to its least neighbour, found
    with a map-side combined minimum and an equi-join that AQE can split, so that a node with very
    many neighbours never becomes one task's list. Each round is checkpointed; O(log^2 n) rounds. Once
    at most ``few`` edges are left, one task does the rest in 16 bytes an edge and some copies of it:
    a round's many small shuffles would take longer than all else, however few rows they have.
    """
    a, b = edges.columns[:2]
    now = stored(edges.select(F.greatest(a, b).cast("long").alias("a"), F.least(a, b).cast("long").alias("b")).where("a <> b"))
    left, state = now.count(), None
    if left > few:
        now = cut(now.distinct())
        left = now.count()
    for _ in range(max_rounds):
        if left <= few:
            return stored(now.coalesce(1).mapInArrow(_joined, "node long, component long"))
        # Large star: each larger neighbour v of u moves to the least neighbour of u.
        two = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = two.join(_least(now, True), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: u and each smaller neighbour move to the least of them.
        small = large.join(_least(large, False), "a")
        now = cut(small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        new = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
        if new == state:
            break
        left, state = new[0], new
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


def split_buckets(rows: DataFrame, keys: list[str], most: int, by: Column) -> DataFrame:
    """Deal rows to blocks so that no block of a bucket holds more than about ``2 * most`` rows.

    A bucket (rows with equal ``keys``) of m rows is cut into nb = ceil(m / most) parts by the hash
    of ``by``; each unordered pair of parts is a block, so every pair of rows of the bucket meets in
    exactly one block if a block compares only rows of different parts, or the rows of one part where
    lo = hi. Adds ``part, lo, hi``. Buckets with one row are left out. Exact: nothing is dropped.
    """
    return deal_blocks(rows.join(rows.groupBy(*keys).agg(F.count("*").alias("_m")).where("_m > 1"), keys), most, by)


def deal_blocks(rows: DataFrame, most: int, by: Column) -> DataFrame:
    """``split_buckets`` of rows that have the size of their bucket as ``_m``."""
    parted = (
        rows
        .withColumn("_nb", F.ceil(F.col("_m") / F.lit(float(most))).cast("int"))
        .withColumn("part", F.pmod(F.xxhash64(by), F.col("_nb")).cast("int"))
        .withColumn("_other", F.explode(F.when(F.col("_nb") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("_nb") - 1))))
    )
    return parted.withColumn("lo", F.least("part", "_other")).withColumn("hi", F.greatest("part", "_other")).drop("_m", "_nb", "_other")


def stream_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Yield tables of whole groups with the row at which each group starts (and the end).

    The batches are sorted by ``keys``. A group that reaches the end of a batch is carried over.
    """
    held: list[pa.RecordBatch] = []

    def starts(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        new[:1] = True
        for k in keys:
            v = t[k].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        t = pa.Table.from_batches(held)
        at = starts(t)
        if len(at) > 1:
            yield t.slice(0, at[-1]), np.append(at[:-1], at[-1])
            rest = t.slice(at[-1]).combine_chunks().to_batches()
            held = list(rest)
    if held:
        t = pa.Table.from_batches(held)
        at = starts(t)
        yield t, np.append(at, t.num_rows)


def in_order(rows: DataFrame, ranges: list[str], ties: list[str]) -> DataFrame:
    """Deal rows to ranges of ``ranges`` (the key, then what orders its rows) and sort each range by these and ``ties``, nulls first.

    A key with very many rows, null included, spreads over as many ranges as its share; ranges follow
    one another in the order of their number, so a key's rows are those of neighbouring ranges.
    """
    return rows.repartitionByRange(partitions(rows.sparkSession), *ranges).sortWithinPartitions(*ranges, *ties)


def runs(batches: Iterator[pa.RecordBatch], key: str = "key") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Of batches from ``in_order``: each batch, where its runs of one key start (and its end), and which runs surely hold all rows of their key.

    A run is cut where its batch ends, so what is held is one batch, however many rows a key has. The
    runs at both ends of a partition may go on in another one and are never called whole.
    """

    def same(a: pa.RecordBatch, i: int, b: pa.RecordBatch, j: int) -> bool:
        return a[key][i].as_py() == b[key][j].as_py()

    held, goes_on = None, True  # the first run may have begun before
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            ends = not same(held, held.num_rows - 1, batch, 0)
            yield _runs(held, key, goes_on, not ends)
            goes_on = not ends
        held = batch
    if held is not None:
        yield _runs(held, key, goes_on, True)


def _runs(batch: pa.RecordBatch, key: str, before: bool, after: bool) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
    codes = batch[key].dictionary_encode(null_encoding="encode").indices.to_numpy()
    starts = np.append(np.flatnonzero(np.append(True, codes[1:] != codes[:-1])), len(codes))
    whole = np.ones(len(starts) - 1, bool)
    whole[0] &= not before
    whole[-1] &= not after
    return batch, starts, whole
