"""SimHash near-duplicates by covering locality-sensitive hashing.

A text's fingerprint is the bitwise majority of the XXH64 hashes of its word shingles. Two
fingerprints within Hamming radius r must collide in one of 2^(r+1) - 1 tables whatever their
bits: every bit position gets a random vector m(i) of r + 1 bits, table v keeps the positions with
<m(i), v> odd, and at most r differing positions cannot span the whole space, so that some nonzero
v is orthogonal to all of them and its table ignores every differing bit. No pair is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm import lines
from siltstone.llm.common import connected_components, partitions, small, split_buckets, stored, stream_groups, words_of

#: Most rows of one part of a bucket; a block compares two parts at once.
PART = 4096
#: Words of a shingle where texts are compared by a similarity, and values and number of the bands that find them.
WORDS, ROWS, TABLES = 5, 4, 24
_ODD = np.random.default_rng(19).integers(0, 1 << 63, ROWS * TABLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: str | None, shingle_words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every run of ``shingle_words`` words (A-Z lower-cased, joined by one space)."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words).lower()  # bytes.lower() changes A-Z only
    digest = xxhash.xxh64_intdigest
    k = min(shingle_words, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    first, last = (ends - sizes)[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    return np.fromiter([digest(line[a:b], seed) for a, b in zip(first, last)], np.uint64, len(first))


def majority(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes; 0 for none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        some = np.ascontiguousarray(hashes[at : at + (1 << 16)])
        ones += np.unpackbits(some.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * ones > len(hashes)).tolist()))


def masks(radius: int, seed: int = 7) -> list[int]:
    """The 2^(radius+1) - 1 table masks over 64 bits, as signed longs."""
    width = radius + 1
    vectors = np.random.default_rng(seed).permutation(np.arange(64) % (1 << width))  # each vector equally often
    found = [sum(1 << i for i in range(64) if bin(int(vectors[i]) & v).count("1") % 2) for v in range(1, 1 << width)]
    return [m - (1 << 64) if m >> 63 else m for m in found]


def _forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints: each is taken up once and compared with those not reached yet."""
    out: list[tuple[int, int]] = []
    rest = fps
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = np.bitwise_count(rest ^ at) <= radius
            if near.any():
                got = rest[near]
                out += [(int(at), int(x)) for x in got.tolist()]
                queue += list(got)
                rest = rest[~near]
    return out


def links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """Edges ``(a, b)`` that connect all distinct fingerprints within ``radius``, transitively.

    ``fps`` has one long column ``fp`` of distinct values. Each bucket of a covering table gives at
    most a spanning forest of its links, never all its pairs; large buckets are cut into blocks.
    """
    spark = fps.sparkSession
    tables = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks(radius))])
    rows = fps.select("fp", F.explode(tables).alias("k")).select("fp", "k.t", "k.key")
    blocks = split_buckets(rows, ["t", "key"], PART, F.col("fp"))
    keys = ["t", "key", "lo", "hi"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in stream_groups(batches, keys):
            fp = t["fp"].to_numpy().astype(np.int64).view(np.uint64)
            size = np.diff(at)
            two = at[:-1][size == 2]
            two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius]
            a, b = fp[two].view(np.int64).tolist(), fp[two + 1].view(np.int64).tolist()
            for i in np.flatnonzero(size > 2).tolist():
                pairs = np.array(_forest(fp[at[i] : at[i + 1]], radius), np.uint64).reshape(-1, 2).view(np.int64)
                a += pairs[:, 0].tolist()
                b += pairs[:, 1].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return blocks.select("fp", *keys).repartition(partitions(spark), *keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def _minhash(hashes: np.ndarray, rows: int = ROWS, tables: int = TABLES) -> tuple[int, int, np.ndarray]:
    """Two sketches of 63 bits and the band keys of a set of hashes."""
    odd = _ODD[: rows * tables]
    low = np.full(len(odd), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2048):
        np.minimum(low, (hashes[at : at + 2048, None] * odd).min(0), out=low)
    place = np.arange(63, dtype=np.uint64)
    one, two = (int((((low[:63] >> np.uint64(at)) & np.uint64(1)) << place).sum()) for at in (24, 25))
    keys = np.arange(1, tables + 1, dtype=np.uint64)
    for column in low.reshape(tables, rows).T:
        keys = (keys ^ column) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(31)
    return one, two, keys.view(np.int64)


def _marked(docs: DataFrame, id_col: str, text_col: str, shingle_words: int, similar: bool) -> DataFrame:
    """``(id, t, fp)`` of each row, t a hash of its text; for ``similar`` also ``u, n, sk, s2, keys``: of the set of its ``WORDS``-word shingles a hash, the size, sketches and the band keys (null without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            fp = np.array([majority(shingle_hashes(t, shingle_words)) for t in texts], np.uint64)
            columns = [b.column(0), b.column(1), pa.array(fp.view(np.int64))]
            if similar:
                more = []
                for t in texts:
                    s = np.unique(shingle_hashes(t, WORDS))
                    more.append((np.uint64(xxhash.xxh64_intdigest(s.tobytes())).view(np.int64).item(), len(s), *_minhash(s)) if len(s) else (None,) * 5)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                columns += [pa.array(c, k) for c, k in zip(zip(*more, strict=True) if more else [[]] * 5, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["id", "t", "fp"] + ["u", "n", "sk", "s2", "keys"] * similar
    kinds = "id long, t long, fp long" + ", u long, n int, sk long, s2 long, keys array<long>" * similar
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("t"), text.alias("text")).mapInArrow(run, kinds)


def similar_links(docs: DataFrame, marked: DataFrame, text_col: str, similarity: float) -> DataFrame:
    """Edges between the fingerprints of texts whose Jaccard over ``WORDS``-word shingles reaches ``similarity``.

    A radius that takes in such texts would need 2^17 covering tables, so these are found by MinHash:
    ``TABLES`` bands of ``ROWS`` values miss a pair at 0.8 with a probability below 1e-5, and the
    links inside the bands' buckets are worked out exactly as among lines.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(shingle_hashes(t, WORDS).view(np.int64)) for t in b.column(0).to_pylist()]
            names = [np.uint64(xxhash.xxh64_intdigest(np.sort(s.view(np.uint64)).tobytes())).view(np.int64).item() for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sets, pa.list_(pa.int64())), pa.array([len(s) for s in sets], pa.int32())], names=["h1", "line", "n"])

    some = marked.where("u IS NOT NULL")
    classes = stored(some.groupBy("u").agg(F.min("fp").alias("one"), F.min("t").alias("t")))
    banded = some.select("u", "sk", "s2", "keys").dropDuplicates(["u"]).select(F.col("u").alias("h1"), "sk", "s2", F.explode("keys").alias("k"))
    most = lines.most_apart(63, similarity, ROWS, 1e-5)
    blocks = stored(lines.near_blocks(stored(lines.shared(banded)), 63, most))
    wanted = small(classes.join(blocks.select(F.col("h1").alias("u")).distinct(), "u", "left_semi").select(F.col("t").alias("_t")).distinct())
    text = F.col(text_col).cast("string")
    found = docs.select(text.alias("text"), F.xxhash64(text).alias("t")).join(wanted, F.col("t") == F.col("_t"), "left_semi")
    sets = stored(found.select("text").mapInArrow(whole, "h1 long, line array<long>, n int").dropDuplicates(["h1"]))
    parts = lines.settled(blocks, sets, 63, most, similarity, lambda s: s)
    ends = parts.join(classes.select(F.col("u").alias("node"), F.col("one").alias("a")), "node").join(classes.select(F.col("u").alias("component"), F.col("one").alias("b")), "component").select("a", "b")
    same = some.select("u", "fp").distinct().join(classes, "u").select(F.col("fp").alias("a"), F.col("one").alias("b"))
    return ends.union(same).where("a <> b").distinct()


def _labelled(docs: DataFrame, id_col: str, text_col: str, shingle_words: int, radius: int, similarity: float | None) -> tuple[DataFrame, DataFrame]:
    """The marked rows, and ``(fp, root)`` of each fingerprint."""
    marked = stored(_marked(docs, id_col, text_col, shingle_words, similarity is not None))
    classes = marked.select("fp").distinct()
    edges = links(classes, radius)
    if similarity is not None:
        edges = edges.union(similar_links(docs, marked, text_col, similarity))
    found = connected_components(edges)
    return marked, classes.join(found, classes.fp == found.node, "left").select("fp", F.coalesce("component", "fp").alias("root"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, radius: int = 3, similarity: float | None = None) -> DataFrame:
    """``(id_col, fp long, component_id long)``: one row per input row.

    component_id is the smallest id whose fingerprint is reachable by links of at most ``radius``
    differing bits. Rows with equal fingerprints (exact copies, all wordless texts) are one class
    and enter the search once, so a group of copies of any size costs one row. Repeated ids keep
    their rows. A row with a null id gets the component of its fingerprint; component_id is null
    only where no row of the component has an id. An empty table gives an empty result; other
    columns are not read, so clashing names do no harm. With ``similarity``, texts whose Jaccard over
    five-word shingles reaches it are linked too, whatever their fingerprints.
    """
    marked, labelled = _labelled(docs, id_col, text_col, shingle_words, radius, similarity)
    ids = marked.groupBy("fp").agg(F.min("id").alias("least")).join(labelled, "fp")
    least = ids.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.join(ids.join(least, "root").select("fp", "component_id"), "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, radius: int = 3, similarity: float | None = None) -> DataFrame:
    """Keep one document of each component: the one with the smallest id (null last), then by a hash of the text.

    All columns of ``docs`` are returned, whatever their names. Rows that repeat an id with another
    text are documents of their own; of rows with equal id and text one stays, whichever. An empty
    table gives an empty result.
    """
    marked, labelled = _labelled(docs, id_col, text_col, shingle_words, radius, similarity)
    ranked = marked.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "t")).alias("first"))
    first = ranked.join(labelled, "fp").groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.id").alias("_id"), F.col("first.t").alias("_t"))
    again = marked.groupBy("id", "t").agg(F.count("*").alias("m")).where("m > 1")
    first = stored(first.join(again, F.col("_id").eqNullSafe(F.col("id")) & (F.col("_t") == F.col("t")), "left").select("_id", "_t", F.col("m").isNotNull().alias("_again")))
    rows = docs.select(F.struct(*docs.columns).alias("doc"))
    rows = rows.select("doc", F.col(f"doc.`{id_col}`").cast("long").alias("id"), F.xxhash64(F.col(f"doc.`{text_col}`").cast("string")).alias("t"))
    kept = rows.join(small(first), F.col("id").eqNullSafe(F.col("_id")) & (F.col("t") == F.col("_t")))
    out = kept.where("NOT _again")
    if first.where("_again").head(1):
        out = out.union(kept.where("_again").dropDuplicates(["id", "t"]))
    return out.select("doc.*")
