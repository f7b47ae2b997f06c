"""Fuzzy line dedup by MinHash, in DataFrame functions alone.

Equal lines form classes first, so that a line in a third of all documents costs one row per task. A
class's shingles are the ``WIDE`` characters at each place of the lower-cased line. Each value of its
signature is the least exclusive-or of a seed and the shingles' hashes, all in one hash aggregate.
The values are the points of an affine plane, whose lines are the bands: any two share one value at
most. Classes that share a band are candidates; one that also agrees in the low bits of enough values
is compared, and its exact Jaccard over all shingles decides. In each bucket all classes are compared
with the bucket's first, then all pairs that the links leave in different components; components of
the links keep their first line.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from functools import reduce
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.llm.common import connected_components, deal_blocks, drop, only, small, stored

WIDE = 5
#: Places of a line whose shingles always enter the signature; of the others those do whose hash is
#: negative, as only these can be least: the seeds are not negative.
FIRST = 64
#: Most classes of one part of a bucket; a block compares two parts at once.
PART = 2048


def order_of(lines: int) -> int:
    """Order of the plane (values of a band): more lines, longer bands, so that buckets stay small."""
    return 4 if lines < 1 << 25 else 5 if lines < 1 << 31 else 7


def bands(order: int, classes: int | None = None) -> list[list[int]]:
    """Lines of the affine plane of that order (4, or a prime) over ``order`` squared points, of as many parallel classes as values of a band if not told."""

    def times(a: int, b: int) -> int:
        if order != 4:
            return a * b % order
        r = (a if b & 1 else 0) ^ ((a << 1) if b & 2 else 0)
        return r ^ 7 if r & 4 else r

    plus = (lambda a, b: a ^ b) if order == 4 else (lambda a, b: (a + b) % order)
    return [[x * order + plus(times(m, x), c) for x in range(order)] for m in range(classes or order) for c in range(order)]


def _seeds(order: int) -> list[int]:
    r = random.Random(5)
    return [r.getrandbits(62) for _ in range(order * order)]


def sketch_bits(values: int) -> int:
    """Bits that a value has in each of the two sketches of 64."""
    return 64 // values if values > 16 else 4


def most_apart(values: int, threshold: float, shared: int, miss: float = 0.003) -> int:
    """The most values in whose low bits two sets of that Jaccard that share a band of ``shared`` values differ, but with a probability of ``miss``."""
    free = values - shared
    p = (1 - threshold) * (1 - 0.25 ** sketch_bits(values))
    tail, t = 1.0, -1
    while tail > miss:
        t += 1
        tail -= comb(free, t) * p**t * (1 - p) ** (free - t)
    return t


def _points(line: Column) -> Column:
    """The lower-cased line, four bytes a character."""
    return F.encode(F.lower(line), "UTF-32")


def shingles(line: Column) -> Column:
    """The hashes of a line's shingles, with repeats: of every ``WIDE`` characters in a row, or of a shorter line as a whole."""

    def each(b: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(b) - (4 * WIDE - 1), F.lit(1)), F.lit(4))
        return F.transform(starts, lambda p: F.xxhash64(F.substring(b, p, F.lit(4 * WIDE))))

    return F.element_at(F.transform(F.array(_points(line)), each), 1)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(did, row, text)``; did and row together tell rows with equal id and different text apart."""
    return docs.select(F.col(id_col).cast("long").alias("did"), F.xxhash64(F.col(id_col).cast("long"), F.col(text_col)).alias("row"), F.col(text_col).cast("string").alias("text"))


def _lines(rows: DataFrame) -> DataFrame:
    """``(did, row, pos, line)`` of the lines that are not blank."""
    return rows.select("did", "row", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).where(F.col("line").rlike(r"\S"))


def _hashes() -> list[Column]:
    return [F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2")]


def signatures(docs: DataFrame, text_col: str, order: int) -> DataFrame:
    """``(h1, v0, v1 ...)``: one row per class of equal lines."""
    lines = docs.select(F.explode(F.split(F.col(text_col).cast("string"), "\n", -1)).alias("line")).where(F.col("line").rlike(r"\S"))
    coded = lines.select(F.xxhash64("line").alias("h1"), _points(F.col("line")).alias("b"))
    placed = coded.select("h1", "b", F.explode(F.sequence(F.lit(0), F.greatest(F.length("b") / 4 - WIDE, F.lit(0)).cast("int"))).alias("i"))
    hashed = placed.select("h1", "i", F.xxhash64(F.substring("b", F.col("i") * 4 + 1, F.lit(4 * WIDE))).alias("h")).where(f"i < {FIRST} OR h < 0")
    return hashed.groupBy("h1").agg(*[F.min(F.col("h").bitwiseXOR(F.lit(s))).alias(f"v{i}") for i, s in enumerate(_seeds(order))])


def coded(classes: DataFrame, order: int) -> DataFrame:
    """``(h1, sk, s2, b0, b1 ...)``: a row for each class, with the low bits of its values and the key of each band."""
    n = order * order
    low = sketch_bits(n)

    def sketch(skip: int) -> Column:
        out = F.lit(0).cast("long")
        for i in range(n):
            out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(f"v{i}", skip).bitwiseAND(F.lit((1 << low) - 1)), low * i))
        return out

    keys = [F.xxhash64(F.lit(j), *[f"v{i}" for i in b]).alias(f"b{j}") for j, b in enumerate(bands(order))]
    return classes.select("h1", sketch(0).alias("sk"), sketch(low).alias("s2"), *keys)


def shared(rows: DataFrame) -> DataFrame:
    """The rows ``(k, h1, sk, s2)`` of buckets of two and more, with the bucket's size as ``_m``."""
    return rows.select("k", "h1", "sk", "s2", F.count("*").over(W.partitionBy("k")).alias("_m")).where("_m > 1")


def buckets(codes: DataFrame, order: int) -> DataFrame:
    """``shared`` of every band of ``coded`` classes, by ``order`` bands at a time: all bands' rows at once would take more disk than the texts."""
    keys = [[f"b{j}" for j in range(at, at + order)] for at in range(0, order * order, order)]
    passes = [stored(shared(codes.select("h1", "sk", "s2", F.explode(F.array(*some)).alias("k")))) for some in keys]
    return reduce(DataFrame.union, passes)


def apart(a: tuple[Column, Column], b: tuple[Column, Column], values: int) -> Column:
    """In how many values' low bits two pairs of sketches differ."""
    low = sketch_bits(values)
    x = a[0].bitwiseXOR(b[0]).bitwiseOR(a[1].bitwiseXOR(b[1]))
    y = x
    for i in range(1, low):
        y = y.bitwiseOR(F.shiftrightunsigned(x, i))
    mask = sum(1 << (low * i) for i in range(values))
    return F.bit_count(y.bitwiseAND(F.lit(mask)))


def _alike(sets: Column, na: Column, nb: Column, threshold: float) -> Column:
    """Whether the Jaccard of the hashes ``a`` and ``b`` of a struct, of na and nb different ones, reaches the threshold."""
    shared = F.element_at(F.transform(F.array(sets), lambda x: F.size(F.array_intersect(x["a"], x["b"]))), 1)
    return (F.least(na, nb) >= F.lit(threshold) * F.greatest(na, nb)) & (shared * (1 + threshold) >= F.lit(threshold) * (na + nb) - 1e-6)


#: Longs of the bit map of a set.
MARKS = 8


def _mark(h: Column, j: int) -> Column:
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))
    return F.when(F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(MARKS - 1)) == j, bit).otherwise(F.lit(0).cast("long"))


def marks(hashes: Column) -> list[Column]:
    """The bit map of a set of hashes, as longs: a bit is set where an element falls."""
    of = lambda j: lambda bits, h: bits.bitwiseOR(_mark(h, j))
    return [F.aggregate(hashes, F.lit(0).cast("long"), of(j)) for j in range(MARKS)]


def marked(sets: DataFrame) -> DataFrame:
    """``(h1, n, m0, m1 ...)``: the bit maps of many sets ``(h1, n, hashes)``, by one aggregate."""
    return sets.select("h1", "n", F.explode("hashes").alias("h")).groupBy("h1", "n").agg(*[F.bit_or(_mark(F.col("h"), j)).alias(f"m{j}") for j in range(MARKS)])


def may_be_alike(a: list[Column], b: list[Column], na: Column, nb: Column, threshold: float) -> Column:
    """False only for sets whose Jaccard is below the threshold: each bit that one bit map alone has stands for at least one element that one set alone has."""
    own = lambda x, y: reduce(lambda s, c: s + c, [F.bit_count(p.bitwiseAND(F.bitwise_not(q))) for p, q in zip(x, y, strict=True)])
    return F.least(na - own(a, b), nb - own(b, a)) * (1 + threshold) >= F.lit(threshold) * (na + nb) - 1e-6


BLOCK = ["k", "lo", "hi"]
#: Most classes of a block that gives its pairs.
SMALL = 64


def near_blocks(seen: DataFrame, values: int, most: int) -> DataFrame:
    """``(k, lo, hi, part, h1, sk, s2)``: the classes that agree in enough values with another of their bucket, in blocks; no pair leaves the join."""
    blocks = deal_blocks(seen, PART, F.col("h1")).select(*BLOCK, "part", "h1", "sk", "s2").repartition(*BLOCK)  # shuffled once for both sides
    other = blocks.select(*[F.col(c).alias(f"_{c}") for c in blocks.columns])
    same = (F.col("k") == F.col("_k")) & (F.col("lo") == F.col("_lo")) & (F.col("hi") == F.col("_hi"))
    meet = (F.col("h1") != F.col("_h1")) & ((F.col("lo") == F.col("hi")) | (F.col("part") != F.col("_part")))
    near = apart((F.col("sk"), F.col("s2")), (F.col("_sk"), F.col("_s2")), values) <= most
    return blocks.join(other, same & meet & near, "left_semi")


def first_links(blocks: DataFrame, texts: DataFrame, values: int, most: int, threshold: float, set_of: Callable[[Column], Column]) -> DataFrame:
    """Edges ``(a, b)`` of a block's classes with its first one by h1 and with the two before them by the sketch's order, in which like ones stand together."""
    ranked = W.partitionBy(*BLOCK).orderBy("sk", "h1")
    every = ranked.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    first = F.struct(F.min("h1").over(every).alias("h1"), *[F.min_by(c, "h1").over(every).alias(c) for c in ("sk", "s2")])
    before = [F.lag(F.struct("h1", "sk", "s2"), i).over(ranked) for i in (1, 2)]
    met = blocks.select("h1", "sk", "s2", F.array(first, *before).alias("others")).select("h1", "sk", "s2", F.explode("others").alias("o"))
    met = met.where((F.col("h1") != F.col("o.h1")) & (apart((F.col("sk"), F.col("s2")), (F.col("o.sk"), F.col("o.s2")), values) <= most))
    pairs = met.select(F.least("h1", "o.h1").alias("a"), F.greatest("h1", "o.h1").alias("b")).distinct()
    return _verified(pairs, texts, threshold, set_of)


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float, set_of: Callable[[Column], Column]) -> DataFrame:
    """The pairs ``(a, b)`` whose Jaccard reaches the threshold."""
    end = lambda x: texts.select(F.col("h1").alias(x), F.col("line").alias(f"l{x}"), F.col("n").alias(f"n{x}"))
    both = pairs.join(end("a"), "a").join(end("b"), "b").where(F.least("na", "nb") >= threshold * F.greatest("na", "nb"))
    return both.where(_alike(F.struct(*[set_of(F.col(f"l{x}")).alias(x) for x in "ab"]), F.col("na"), F.col("nb"), threshold)).select("a", "b")


def unsettled(blocks: DataFrame, parts: DataFrame) -> DataFrame:
    """``(k, lo, hi, part, h1, sk, s2, c, m)``: the rows of the blocks whose m classes are not all in one component c yet."""
    named = blocks.join(small(parts), F.col("h1") == F.col("node"), "left").select(*BLOCK, "part", "h1", "sk", "s2", F.coalesce("component", "h1").alias("c"))
    block = W.partitionBy(*BLOCK)  # of at most some 2 * PART rows
    still = named.select("*", F.count("*").over(block).alias("m"), F.min("c").over(block).alias("c0"), F.max("c").over(block).alias("c1"))
    return stored(still.where("m > 2 AND c0 <> c1").drop("c0", "c1"))


def more_links(full: DataFrame, texts: DataFrame, values: int, most: int, threshold: float, set_of: Callable[[Column], Column], again: int) -> DataFrame:
    """Edges ``(a, b)`` of each class with the four before it in two orders of its block, an arbitrary one and one of part of its sketch, but for those of its component; other ones each time."""
    mixed = F.xxhash64(F.lit(again), "h1")
    orders = [mixed, F.shiftrightunsigned("s2" if again % 2 else "sk", 16 * (1 + again // 2) % 64)]
    before = [F.lag(F.struct("h1", "c", "sk", "s2"), i).over(W.partitionBy(*BLOCK).orderBy(o, mixed)) for o in orders for i in range(1, 5)]
    met = full.select("h1", "c", "sk", "s2", F.array(*before).alias("others")).select("h1", "c", "sk", "s2", F.explode("others").alias("o"))
    met = met.where((F.col("c") != F.col("o.c")) & (apart((F.col("sk"), F.col("s2")), (F.col("o.sk"), F.col("o.s2")), values) <= most))
    return _verified(met.select(F.least("h1", "o.h1").alias("a"), F.greatest("h1", "o.h1").alias("b")).distinct(), texts, threshold, set_of)


def rest_links(full: DataFrame, texts: DataFrame, values: int, most: int, threshold: float, set_of: Callable[[Column], Column]) -> DataFrame:
    """Edges ``(a, b)`` between classes of an ``unsettled`` block that no link has joined yet.

    Every pair of classes of different components that agree in enough values is compared, by bit maps
    first, which rule out most. A small block gives its other pairs, which other blocks may give too,
    once; from a large one only links leave the join.
    """
    first = F.when(F.col("lo") < F.col("hi"), F.col("pa") < F.col("pb")).otherwise(F.col("a") < F.col("b"))
    meet = first & (F.col("ca") != F.col("cb")) & (apart((F.col("ka"), F.col("la")), (F.col("kb"), F.col("lb")), values) <= most)
    may = may_be_alike(*[[F.col(f"m{x}{j}") for j in range(MARKS)] for x in "ab"], F.col("na"), F.col("nb"), threshold)
    left = texts.join(full.select("h1").distinct(), "h1", "left_semi")
    known = full.join(stored(marked(left.select("h1", "n", set_of(F.col("line")).alias("hashes")))), "h1")

    def ends(rows: DataFrame, *more: Column) -> list[DataFrame]:
        dealt, names = rows.repartition(*BLOCK), {"h1": "", "part": "p", "c": "c", "sk": "k", "s2": "l", "n": "n"}  # shuffled once for both ends
        return [dealt.select(*BLOCK, *[F.col(c).alias(f"{to}{x}") for c, to in names.items()], *[F.col(f"m{j}").alias(f"m{x}{j}") for j in range(MARKS)], *[c.alias(f"s{x}") for c in more]) for x in "ab"]

    a, b = ends(known.where(F.col("m") <= SMALL))
    links = _verified(a.join(b, BLOCK).where(meet & may).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), texts, threshold, set_of)
    a, b = ends(known.where(F.col("m") > SMALL).join(texts.select("h1", "line"), "h1"), set_of(F.col("line")))  # the line is shuffled, not its shingles
    alike = _alike(F.struct(F.col("sa").alias("a"), F.col("sb").alias("b")), F.col("na"), F.col("nb"), threshold)
    return links.union(a.join(b, BLOCK).where(meet & may & alike).select("a", "b"))


#: How often the classes of large blocks are compared with some others before all that are still apart are, if these blocks have so many pairs.
PASSES, PAIRS = 3, 1 << 21
#: After a pass with fewer links than one for so many rows there is no other, as what is left is hardly alike.
FEW = 100


def settled(blocks: DataFrame, texts: DataFrame, values: int, most: int, threshold: float, set_of: Callable[[Column], Column] = shingles, passes: int = PASSES, worth: int = PAIRS) -> DataFrame:
    """``(node, component)`` by all links inside the blocks; ``set_of`` makes the hashes of the ``line`` in ``texts (h1, line, n)``, n different ones each.

    Most of a large group of near copies is joined by a few comparisons of each class; what is then
    compared and linked with all others is the rest, so that links don't grow with the square of a group.
    """
    links = stored(first_links(blocks, texts, values, most, threshold, set_of))
    parts = connected_components(links)
    full = unsettled(blocks, parts)
    for again in range(passes):
        large = full.where(F.col("m") > SMALL)
        n, pairs = large.agg(F.count("*"), F.coalesce(F.sum("m"), F.lit(0))).first()
        if pairs < 2 * worth:  # a block's rows have m each
            break
        more = stored(more_links(large, texts, values, most, threshold, set_of, again))
        found = more.count()
        if found:
            parts = connected_components(parts.select("node", "component").union(more))
            before, full = full, unsettled(full.select("k", "lo", "hi", "part", "h1", "sk", "s2"), parts)
            drop(before)
        if found * FEW < n:
            break
    more = stored(rest_links(full, texts, values, most, threshold, set_of))
    return connected_components(parts.select("node", "component").union(more)) if more.head(1) else parts


def components(rows: DataFrame, classes: DataFrame, lines: int, threshold: float) -> DataFrame:
    """``(node, h2, component)`` of classes, by h1, linked by a Jaccard over all shingles that reaches the threshold; ``classes`` has ``(h1, h2, n, at)``."""
    order = order_of(lines)
    values, most = order * order, most_apart(order * order, threshold, order)

    def near() -> DataFrame:
        codes = stored(coded(signatures(rows, "text", order), order))
        seen = buckets(codes, order)
        drop(codes)
        return near_blocks(seen, values, most)

    blocks = only(near)
    wanted = stored(classes.join(small(blocks.select("h1").distinct()), "h1", "left_semi").groupBy("h1").agg(F.min(F.struct("h2", "at")).alias("x")).select("h1", "x.h2", "x.at.did", "x.at.row", "x.at.pos"))
    at = wanted.groupBy("did", "row").agg(F.collect_list(F.struct("pos", "h1")).alias("at"))  # bounded by the lines of one text
    found = rows.join(small(at.select(F.col("did").alias("_did"), F.col("row").alias("_row"), "at"), F.size("at") * 4), F.col("did").eqNullSafe(F.col("_did")) & (F.col("row") == F.col("_row")))
    picked = found.select("at", F.split("text", "\n", -1).alias("all")).select(F.explode(F.element_at(F.transform(F.array("all"), lambda a: F.transform("at", lambda x: F.struct(x["h1"].alias("h1"), F.get(a, x["pos"]).alias("line")))), 1)).alias("x"))
    texts = stored(picked.select("x.h1", "x.line", F.size(F.array_distinct(shingles(F.col("x.line")))).alias("n")))
    parts = only(lambda: settled(blocks, texts, values, most, threshold))
    drop(blocks, texts)
    return parts.join(wanted.select("h1", "h2"), F.col("node") == F.col("h1")).select("node", "h2", "component")


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """``(did, row, gone)``: for each row of ``_rows`` that loses lines, their positions."""
    rows = _rows(docs, id_col, text_col)
    lines = stored(_lines(rows).select("did", "row", "pos", *_hashes()))
    place = F.struct(F.col("did").isNull().alias("no_id"), "did", "row", "pos")
    classes = stored(lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(place).alias("at")))
    parts = components(rows, classes, lines.count(), threshold)
    linked = parts.select("node", F.col("h2").alias("_h2"), "component")
    known = classes.join(small(stored(linked)), (F.col("h1") == F.col("node")) & (F.col("h2") == F.col("_h2")), "left").where("n > 1 OR node IS NOT NULL")
    known = stored(known.select("h1", "h2", "at", "component"))
    first = known.where("component IS NOT NULL").groupBy(F.col("component").alias("c")).agg(F.min("at").alias("keeper"))
    kept = known.join(small(stored(first)), F.col("component") == F.col("c"), "left").select("h1", "h2", F.coalesce("keeper", "at").alias("keeper"))
    kept = small(stored(kept.select("h1", "h2", F.col("keeper.row").alias("r"), F.col("keeper.did").alias("d"), F.col("keeper.pos").alias("i"))))
    gone = lines.join(kept, ["h1", "h2"]).where("NOT (row = r AND did <=> d AND pos = i)")
    return gone.groupBy("did", "row").agg(F.collect_set("pos").alias("gone"))


def _deduped(docs: DataFrame, id_col: str, text_col: str, threshold: float) -> DataFrame:
    """``(doc, text, n_lines, n_removed)``: each row as a struct, and its kept lines."""
    gone = only(lambda: removed_lines(docs, id_col, text_col, threshold).select(F.col("did").alias("_did"), F.col("row").alias("_row"), "gone"))
    gone = small(gone, F.size("gone"))
    rows = docs.select(F.struct(*docs.columns).alias("doc"))
    rows = rows.select("doc", F.col(f"doc.`{id_col}`").cast("long").alias("did"), F.col(f"doc.`{text_col}`").cast("string").alias("text"))
    rows = rows.withColumn("row", F.xxhash64("did", "text"))
    joined = rows.join(gone, F.col("did").eqNullSafe(F.col("_did")) & (F.col("row") == F.col("_row")), "left")
    left = lambda a: F.array_except(F.sequence(F.lit(0), F.size(a) - 1), F.col("gone"))
    kept = F.element_at(F.transform(F.array(F.split("text", "\n", -1)), lambda a: F.array_join(F.transform(left(a), lambda i: F.get(a, i)), "\n")), 1)
    n = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1
    count = F.when(F.coalesce(F.length("text"), F.lit(0)) == 0, 0).otherwise(n).cast("long").alias("n_lines")
    return joined.select("doc", F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("text"), count, F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """All columns of ``docs`` with the text's kept lines as ``text_col``, and two long columns: its number of lines, and of removed lines.

    Lines are what stands between line feeds. Of each component of lines linked by Jaccard >=
    threshold the first stays: by smallest id (null last), then position. Blank lines are left alone.
    Null and empty texts have no lines and stay as they are. Rows that repeat an id with equal text
    are one document and lose the same lines; with other text they are told apart by content. An
    empty table gives an empty result; other columns pass through whatever their names, except that
    columns named as ``counts`` are replaced.
    """
    done = _deduped(docs, id_col, text_col, threshold)
    own = [F.col("text").alias(c) if c == text_col else F.col(f"doc.`{c}`").alias(c) for c in docs.columns if c not in counts]
    return done.select(*own, F.col("n_lines").alias(counts[0]), F.col("n_removed").alias(counts[1]))


def keep_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """``docs`` with the kept lines as their texts; documents that lost all their lines go."""
    done = _deduped(docs, id_col, text_col, threshold).where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    return done.select(*[F.col("text").alias(c) if c == text_col else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
