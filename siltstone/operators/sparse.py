"""BM25 over an inverted index in shards, for a batch of questions at once.

Index. The chunks of an Arrow batch, up to SHARD characters, are a shard. A shard's postings are worked
out where its texts are read, so no token is shuffled: one row a term with the chunks' places in the
shard and the term's counts there, and bounds of both for the whole row and for each BLOCK postings; one
more row has the chunks' ids and lengths. Rows lie in folders by a hash of the term, sorted by term.

Search. Only folders of asked terms are read, and of them only the rows of asked terms move, to the task
of their shard. There each question is answered by MaxScore: terms whose bounds together cannot reach
the question's k-th best score so far name no candidates; of the others, blocks whose bound cannot are
skipped; what is left of the first terms is looked up for the remaining candidates only. The result is
that of scoring every posting. A task keeps the k best of a question over all its shards.

A stored index grows by batches (``add``): shards of new chunks stand beside the old ones, counts of terms
and lengths are added up when it is loaded, and the bounds of blocks hold whatever the mean length. A
batch counts once it is whole, and once however often it is added.

Chunk ids are keys; chunks without id are left out, null texts are empty.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from siltstone.functions.text import terms
from siltstone.operators.nearest import Best, rounded
from siltstone.sources.scratch import stored

K1, B, EPSILON = 1.5, 0.75, 0.25

#: Weighted query terms that are sent to all tasks at once; more are answered in blocks of questions.
MOST_TERMS = 500_000
#: Characters of a shard, postings of a block, folders of terms.
SHARD, BLOCK, FOLDERS = 1 << 24, 128, 64
#: Characters whose tokens a task holds at once.
HELD = 1 << 20
_TERM = re.compile("[a-z0-9]+")
_LISTS = ["ords", "tfs", "block_tf", "block_dl"]


@dataclass
class SparseIndex:
    """``blocks(shard, term, n, ords, tfs, block_tf, block_dl, ids, dls, folder)``, ``vocabulary(term, df, folder)``, ``totals(n, avgdl, mean_raw)``.

    A row of ``blocks`` without term has the ``ids`` and lengths ``dls`` of its shard's chunks.
    """

    blocks: DataFrame
    vocabulary: DataFrame
    totals: DataFrame

    @property
    def postings(self) -> DataFrame:
        """``chunk_id, term, tf, dl``, one row a posting."""
        named = self.blocks.where("folder = -1").select("shard", "ids", "dls")
        each = self.blocks.where("folder >= 0").select("shard", "term", F.explode(F.arrays_zip("ords", "tfs")).alias("p"))
        return each.join(named, "shard").select(F.get("ids", F.col("p.ords")).alias("chunk_id"), "term", F.col("p.tfs").alias("tf"), F.get("dls", F.col("p.ords")).alias("dl"))


def _folder(term: Column) -> Column:
    return F.pmod(F.crc32(F.encode(term, "UTF-8")), F.lit(FOLDERS)).cast("int")


def _parts(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Where parts of texts of these sizes begin and end: at most ``most`` characters, or one text."""
    at = 0
    while at < len(sizes):
        upto = max(at + 1, at + int(np.searchsorted(np.cumsum(sizes[at : at + most]), most, "right")))
        yield at, upto
        at = upto


def _shard(number: int, ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """The rows of one shard. Tokens are counted by few texts at a time, so that what is held are the postings."""
    dls, ords, tfs = ([np.zeros(0, np.int32)] for _ in range(3))
    coded = []
    for at, upto in _parts(pc.utf8_length(texts).to_numpy(), HELD):
        found = [_TERM.findall(t) for t in texts.slice(at, upto - at).to_pylist()]
        dls.append(np.array([len(f) for f in found], np.int32))
        tokens = pa.array(chain.from_iterable(found), pa.string()).dictionary_encode()
        pairs, n = np.unique(tokens.indices.to_numpy().astype(np.int64) * len(found) + np.repeat(np.arange(len(found)), dls[-1]), return_counts=True)
        code, ord_ = np.divmod(pairs, len(found))
        coded.append(pa.DictionaryArray.from_arrays(pa.array(code.astype(np.int32)), tokens.dictionary))
        ords.append((ord_ + at).astype(np.int32))
        tfs.append(n.astype(np.int32))
    dls, ords, tfs = map(np.concatenate, (dls, ords, tfs))
    terms_of = pa.chunked_array(coded, pa.dictionary(pa.int32(), pa.string())).unify_dictionaries().combine_chunks()
    codes = terms_of.indices.to_numpy()
    order = np.argsort(codes, kind="stable")  # by term, then by place, as parts follow one another
    codes, ords, tfs = codes[order], ords[order], tfs[order]
    names, n_docs = terms_of.dictionary, len(texts)
    sizes = np.bincount(codes, minlength=len(names))
    ends = np.cumsum(sizes)
    begins = ends - sizes
    # first posting of each block of a term
    counts = -(-sizes // BLOCK)
    block_ends = np.cumsum(counts)
    starts = np.repeat(begins, counts) + BLOCK * (np.arange(counts.sum()) - np.repeat(block_ends - counts, counts))
    bound = lambda f, x: f.reduceat(x, starts) if len(starts) else np.zeros(0, np.int64)
    lists = [(ords, ends), (tfs, ends), (bound(np.maximum, tfs), block_ends), (bound(np.minimum, dls[ords]), block_ends)]
    n = len(names)
    # the last row, without term, is the shard's own
    columns = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], e, e[-1:] if n else [0]]).astype(np.int32)), pa.array(v.astype(np.int32))) for v, e in lists]
    none = [0] * (n + 1)
    own = [pa.ListArray.from_arrays(pa.array(np.array([*none, n_docs], np.int32)), v) for v in (ids, pa.array(dls))]
    return pa.RecordBatch.from_arrays([pa.array(np.full(n + 1, number)), pa.concat_arrays([names, pa.array([None], pa.string())]), pa.array(np.append(sizes, n_docs).astype(np.int64)), *columns, *own], ["shard", "term", "n", *_LISTS, "ids", "dls"])


def _dealt(chunks: DataFrame, id_col: str, text_col: str, batch: int) -> DataFrame:
    """The rows of ``blocks``; numbers of shards begin with that of the batch."""
    kind = chunks.schema[id_col].dataType
    named = chunks.select(F.col(id_col).alias("chunk_id"), F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text")).where("chunk_id IS NOT NULL")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = (batch << 40) + (TaskContext.get().partitionId() << 20)
        for rows in batches:
            for at, upto in _parts(pc.utf8_length(rows["text"]).to_numpy(), SHARD):
                yield _shard(number, rows["chunk_id"].slice(at, upto - at), rows["text"].slice(at, upto - at))
                number += 1

    arrays = ", ".join(f"{c} array<int>" for c in _LISTS)
    made = named.mapInArrow(shards, f"shard long, term string, n long, {arrays}, ids array<{kind.simpleString()}>, dls array<int>")
    return made.withColumn("folder", F.coalesce(_folder(F.col("term")), F.lit(-1))).hint("rebalance", "folder").sortWithinPartitions("folder", "term", "shard")


def _counted(blocks: DataFrame) -> DataFrame:
    return blocks.where("folder >= 0").groupBy("folder", "term").agg(F.sum("n").alias("df")).sortWithinPartitions("folder", "term")


def _sizes(blocks: DataFrame) -> DataFrame:
    """``n, length``: chunks and their terms in all."""
    length = F.sum(F.aggregate("dls", F.lit(0).cast("long"), lambda s, x: s + x))
    return blocks.where("folder = -1").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(length, F.lit(0)).alias("length"))


def _totals(vocabulary: DataFrame, sizes: DataFrame) -> DataFrame:
    raw = vocabulary.join(F.broadcast(sizes)).agg(F.avg(_raw()).alias("mean_raw"))
    return sizes.join(F.broadcast(raw)).select("n", F.try_divide("length", "n").alias("avgdl"), "mean_raw")


def build(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> SparseIndex:
    """The index of all chunks, written to the shared folder."""
    blocks = stored(_dealt(chunks, id_col, text_col, 0), "folder")
    vocabulary = stored(_counted(blocks), "folder").select("term", "df", "folder")
    return SparseIndex(blocks, vocabulary, stored(_totals(vocabulary, _sizes(blocks))))


def _raw() -> Column:
    return F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)


def idf(index: SparseIndex) -> DataFrame:
    """``term, df, idf``: negative values become EPSILON times the mean over all terms."""
    each = index.vocabulary.join(F.broadcast(index.totals.select("n", "mean_raw"))).withColumn("raw", _raw())
    return each.select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean_raw")).otherwise(F.col("raw")).alias("idf"))


def gain(tf: np.ndarray, dl: np.ndarray, avgdl: float) -> np.ndarray:
    """What a posting adds, without the weight of its term; it grows with tf and falls with dl."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


@dataclass
class _Posting:
    """The postings of one term in one shard."""

    ords: np.ndarray
    tfs: np.ndarray
    tops: np.ndarray  # the most that a posting of each block can add

    @property
    def top(self) -> float:
        return float(self.tops.max())


def rank_shard(weighted: list[tuple[_Posting, float]], dls: np.ndarray, avgdl: float, least: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Places in the shard of all chunks that reach ``least``, with their scores, and how many postings were scored.

    Others that come near may be among them. With a negative weight bounds mean nothing, and all are scored.
    """
    ordered = sorted(weighted, key=lambda x: x[0].top * x[1])
    plain = least == -np.inf or any(w < 0 for _, w in ordered)
    upto = np.cumsum([p.top * w for p, w in ordered])  # what a chunk can have from the first terms
    named = np.zeros(len(dls), bool)
    for i, (p, w) in enumerate(ordered):
        if plain:
            named[p.ords] = True
        elif upto[i] >= least:
            kept = p.tops * w + (upto[-1] - p.top * w) >= least
            named[p.ords if kept.all() else p.ords[np.repeat(kept, BLOCK)[: len(p.ords)]]] = True
    found, scores, scored = np.flatnonzero(named), np.zeros(len(dls)), 0
    for i in range(len(ordered) - 1, -1, -1):
        p, w = ordered[i]
        if not plain:
            found = found[scores[found] + upto[i] >= least]
        if 16 * len(found) < len(p.ords):
            at = np.minimum(np.searchsorted(p.ords, found), len(p.ords) - 1)
            at = at[p.ords[at] == found]
        else:
            named[:] = False
            named[found] = True
            at = np.flatnonzero(named[p.ords])
        ords = p.ords[at]
        scores[ords] += w * gain(p.tfs[at], dls[ords], avgdl)
        scored += len(at)
    return found, scores[found], scored


def _asked(index: SparseIndex, queries: DataFrame, query_col: str, text_col: str) -> Iterator[tuple[list, dict[str, list[tuple[int, float]]]]]:
    """Blocks of questions: their ids, and for each term of the index the questions (by place) with its weight there."""
    asked = queries.select(F.col(query_col).alias("query_id"), F.explode(terms(F.coalesce(F.col(text_col), F.lit("")))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qn"))
    asked = stored(asked)
    blocks = -(-asked.count() // MOST_TERMS)
    totals = index.totals.first()
    for b in range(blocks):
        some = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        rows = some.toArrow()
        wanted = sorted(set(rows["term"].to_pylist()))
        known = _rows_of(index.vocabulary, wanted).select("term", "df").toArrow()
        weight = {}
        for term, df in zip(known["term"].to_pylist(), known["df"].to_pylist(), strict=True):
            raw = math.log(totals.n - df + 0.5) - math.log(df + 0.5)
            weight[term] = raw if raw >= 0 else EPSILON * totals.mean_raw
        ids, by_term, places = [], {}, {}
        for q, term, n in zip(rows["query_id"].to_pylist(), rows["term"].to_pylist(), rows["qn"].to_pylist(), strict=True):
            if term in weight:
                key = str(q) if isinstance(q, dict) else q
                if key not in places:
                    places[key] = len(ids)
                    ids.append(q)
                by_term.setdefault(term, []).append((places[key], n * weight[term]))
        if ids:
            yield ids, by_term


def _rows_of(table: DataFrame, wanted: list[str]) -> DataFrame:
    """The rows of some terms; only their folders are read."""
    folders = sorted({zlib.crc32(t.encode()) % FOLDERS for t in wanted})
    named = table.sparkSession.createDataFrame(pa.table({"term": pa.array(wanted, pa.string())}))
    return table.where(F.col("folder").isin(folders)).join(F.broadcast(named), "term", "left_semi")


def _scored(index: SparseIndex, queries: DataFrame, k: int | None, query_col: str, text_col: str, digits: int, touched=None) -> DataFrame:
    """``query_id, chunk_id, score``: the k best of each question and task, or all chunks that share a term with it."""
    spark, avgdl = queries.sparkSession, index.totals.first().avgdl
    kinds = [queries.schema[query_col].dataType, index.blocks.schema["ids"].dataType.elementType]
    types, schema = [to_arrow_type(t) for t in kinds], f"query_id {kinds[0].simpleString()}, chunk_id {kinds[1].simpleString()}, score double"
    out = spark.createDataFrame([], schema)
    for names, by_term in _asked(index, queries, query_col, text_col):
        sent = spark.sparkContext.broadcast((names, by_term))

        def rank(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, by_term = sent.value
            best = Best(len(names), k) if k else None

            def rows(q: int, ids: list, scores: np.ndarray) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array([names[q]] * len(ids), types[0]), pa.array(ids, types[1]), pa.array(scores)], ["query_id", "chunk_id", "score"])

            for ids, dls, held in _shards(batches, avgdl):
                asked: dict[int, list[tuple[_Posting, float]]] = {}
                for term, posting in held.items():
                    for q, w in by_term[term]:
                        asked.setdefault(q, []).append((posting, w))
                for q, weighted in asked.items():
                    least = best.least[q] - 10.0**-digits if k else -np.inf
                    found, scores, scored = rank_shard(weighted, dls, avgdl, least)
                    if touched is not None:
                        touched.add(scored)
                    scores = rounded(scores, digits)
                    if k is None:
                        yield rows(q, ids[found].tolist(), scores)
                        continue
                    good = scores > 0
                    if good.any():
                        best.add(np.array([q]), scores[good][None], ids[found[good]])
            for q, scores, ids in best.rows() if k else ():
                yield rows(q, ids.tolist(), scores)

        picked = _rows_of(index.blocks, list(by_term)).unionByName(index.blocks.where("folder = -1"))
        # a shard's own row first, then its terms
        together = picked.drop("n", "folder").repartition("shard").sortWithinPartitions("shard", F.col("term").asc_nulls_first())
        out = out.unionByName(together.mapInArrow(rank, schema))
    return out


def _shards(batches: Iterator[pa.RecordBatch], avgdl: float) -> Iterator[tuple[np.ndarray, np.ndarray, dict[str, _Posting]]]:
    """Ids, lengths and asked postings of one shard after the other; a shard's own row comes first."""
    ids, dls, held, now = None, None, {}, None
    for batch in batches:
        if not batch.num_rows:
            continue
        lists = {c: (batch[c].offsets.to_numpy(), batch[c].values.to_numpy()) for c in (*_LISTS, "dls")}
        names, shards = batch["term"].to_pylist(), batch["shard"].to_pylist()
        part = lambda c, i: lists[c][1][lists[c][0][i] : lists[c][0][i + 1]]  # noqa: B023, E731
        for i, (term, shard) in enumerate(zip(names, shards, strict=True)):
            if term is None:
                if held:
                    yield ids, dls, held
                own = batch["ids"][i].values
                ids = own.to_numpy() if pa.types.is_integer(own.type) else np.array(own.to_pylist(), object)
                dls, held, now = part("dls", i), {}, shard
            elif shard == now:
                held[term] = _Posting(part("ords", i), part("tfs", i), gain(part("block_tf", i), part("block_dl", i), avgdl))
    if held:
        yield ids, dls, held


def score(index: SparseIndex, queries: DataFrame, query_col: str = "query_id", text_col: str = "text", digits: int = 6) -> DataFrame:
    """``query_id, chunk_id, score``: all chunks that share a term with a query; repeated query terms add each time."""
    return _scored(index, queries, None, query_col, text_col, digits)


def top_k(scores: DataFrame, k: int, order: list | None = None, by: str = "query_id") -> DataFrame:
    """The best k rows of each query with their 1-based ``rank``; ties by chunk_id. Spark cuts to k before the shuffle."""
    if k <= 0:
        raise ValueError("k must be positive")
    rank = F.row_number().over(W.partitionBy(by).orderBy(*(order or [F.col("score").desc(), F.col("chunk_id")])))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)


def search(index: SparseIndex, queries: DataFrame, k: int = 10, query_col: str = "query_id", text_col: str = "text", digits: int = 6, touched=None) -> DataFrame:
    """``query_id, chunk_id, score, rank`` with positive scores: the k best of ``score``, by fewer postings.

    ``touched``, an accumulator, counts the postings that were scored.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    return top_k(_scored(index, queries, k, query_col, text_col, digits, touched), k)


def save(index: SparseIndex, path: str) -> None:
    """The whole index as one batch, in place of whatever ``path`` had."""
    first = F.lit(0).alias("batch")
    index.blocks.select(*_BLOCKS, first).sortWithinPartitions("folder", "term", "shard").write.mode("overwrite").partitionBy("batch", "folder").parquet(f"{path}/blocks")
    index.vocabulary.select("term", "df", "folder", first).sortWithinPartitions("folder", "term").write.mode("overwrite").partitionBy("batch", "folder").parquet(f"{path}/vocabulary")
    _sizes(index.blocks).select("n", "length", first).write.mode("overwrite").partitionBy("batch").parquet(f"{path}/batches")
    index.totals.withColumn("batches", F.array(F.lit(0))).withColumn("batch", F.lit(0)).write.mode("overwrite").partitionBy("batch").parquet(f"{path}/totals")


_BLOCKS = ["shard", "term", "n", *_LISTS, "ids", "dls", "folder"]


def add(chunks: DataFrame, path: str, batch: int, id_col: str = "chunk_id", text_col: str = "text") -> None:
    """Add new chunks to the index at ``path`` (or begin it) as batch ``batch``; the same batch again replaces itself.

    The row of ``batches``, written after all else, makes the batch count; without it nothing of it is read.
    """
    spark = chunks.sparkSession
    rows, at = _dealt(chunks, id_col, text_col, batch), f"batch={batch}"
    rows.write.mode("overwrite").partitionBy("folder").parquet(f"{path}/blocks/{at}")
    blocks = spark.read.schema(rows.schema).parquet(f"{path}/blocks/{at}")
    _counted(blocks).write.mode("overwrite").partitionBy("folder").parquet(f"{path}/vocabulary/{at}")
    _sizes(blocks).write.mode("overwrite").parquet(f"{path}/batches/{at}")
    index, committed = _read(spark, path)
    index.totals.withColumn("batches", F.array(*map(F.lit, committed))).write.mode("overwrite").parquet(f"{path}/totals/{at}")


def _read(spark: SparkSession, path: str) -> tuple[SparseIndex, list[int]]:
    """The index of the batches that count, with totals worked out anew; and these batches."""
    sizes = spark.read.parquet(f"{path}/batches")
    committed = sorted(r.batch for r in sizes.select("batch").distinct().collect())
    counts = lambda name: spark.read.parquet(f"{path}/{name}").where(F.col("batch").isin(committed)).drop("batch")
    vocabulary = counts("vocabulary")
    if len(committed) > 1:
        vocabulary = vocabulary.groupBy("folder", "term").agg(F.sum("df").alias("df"))
    totals = _totals(vocabulary, sizes.agg(F.sum("n").alias("n"), F.sum("length").alias("length")))
    return SparseIndex(counts("blocks"), vocabulary.select("term", "df", "folder"), totals), committed


def load(spark: SparkSession, path: str) -> SparseIndex:
    from siltstone.sources.tables import exists

    if not exists(spark, f"{path}/batches"):
        raise FileNotFoundError(f"no index at {path}: index first")
    index, committed = _read(spark, path)
    if exists(spark, f"{path}/totals"):
        known = spark.read.parquet(f"{path}/totals").where(F.col("batches") == F.array(*map(F.lit, committed))).limit(1)
        index.totals = known.select("n", "avgdl", "mean_raw") if known.take(1) else index.totals
    return index
