"""Chunkers: fixed windows, recursive splitting with overlap, and semantic breaks.

Fixed and recursive chunking are map-only expressions over each text; semantic chunking needs one
shuffle by section. The tokenizer is the lossless one of ``functions.text`` unless another is given, such
as the byte-pair tokenizer of ``operators.subwords``.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions.text import n_pieces, pieces, sentences, strip
from siltstone.functions.vectors import dot

STRATEGIES = ("fixed", "recursive", "semantic")
SEPARATORS = ("\n\n", "\n", ". ", " ")


def check_sizes(size: int, overlap: int) -> None:
    if size <= 0 or overlap < 0 or overlap >= size:
        raise ValueError(f"size must be positive and overlap in [0, size); got {size}, {overlap}")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once per row, not once per element of a lambda around it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _windows(tokens: Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` tokens, each ``size - overlap`` after the last; the one that reaches the end is the last."""
    n, step = F.size(tokens), size - overlap
    last = F.greatest(F.lit(0), F.ceil((n - size) / F.lit(float(step)))).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(tokens, i * step + 1, F.lit(size)), ""))


def fixed(text: Column, size: int = 512, overlap: int = 64) -> Column:
    """Array of chunks; blank texts give none, short ones themselves."""
    check_sizes(size, overlap)
    blank = strip(text) == ""
    return F.when(blank | text.isNull(), F.array().cast("array<string>")).otherwise(_let(pieces(text), lambda t: F.when(F.size(t) <= size, F.array(text)).otherwise(_windows(t, size, overlap))))


def _split(part: Column, separator: str) -> Column:
    """Parts with the separator put back on all but the last; empty ones dropped."""
    ended = lambda got: F.transform(got, lambda p, i: F.when(i < F.size(got) - 1, F.concat(p, F.lit(separator))).otherwise(p))
    return F.filter(_let(F.split(part, f"\\Q{separator}\\E", -1), ended), lambda p: p != "")


def _level(separator: str, size: int) -> Callable[[Column], Column]:
    """One level of splitting: fragments that fit or lack the separator pass on."""

    def split(f: Column) -> Column:
        parts = F.transform(_split(f["t"], separator), lambda p: F.struct(p.alias("t"), n_pieces(p).alias("n")))
        return F.when((f["n"] <= size) | ~F.contains(f["t"], F.lit(separator)), F.array(f)).otherwise(parts)

    return split


def fragments(text: Column, size: int) -> Column:
    """array<struct<t: string, n: int>>: parts of at most ``size`` tokens, cut at the coarsest separators that do."""
    sized = lambda p: F.struct(p.alias("t"), n_pieces(p).alias("n"))
    made = F.transform(F.array(text), sized)
    for s in SEPARATORS:
        made = F.flatten(F.transform(made, _level(s, size)))
    cut = lambda f: F.transform(_let(pieces(f["t"]), lambda t: _windows(t, size, 0)), sized)
    return F.flatten(F.transform(made, lambda f: F.when(f["n"] <= size, F.array(f)).otherwise(cut(f))))


def recursive(text: Column, size: int = 512, overlap: int = 64) -> Column:
    """Array of chunks: fragments merged while the sum of their tokens fits, then each chunk but the
    first led by the last ``overlap`` tokens of the one before."""
    check_sizes(size, overlap)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("t"), F.lit(0).alias("n"))

    def merge(acc: Column, f: Column) -> Column:
        fits = acc["n"] + f["n"] <= size
        return F.struct(
            F.when(fits | (acc["t"] == ""), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["t"]))).alias("done"),
            F.when(fits, F.concat(acc["t"], f["t"])).otherwise(f["t"]).alias("t"),
            F.when(fits, acc["n"] + f["n"]).otherwise(f["n"]).alias("n"),
        )

    merged = F.aggregate(fragments(text, size), start, merge, lambda acc: F.when(acc["t"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["t"]))))
    kept = F.filter(merged, lambda c: strip(c) != "")
    if overlap:
        tail = lambda c: _let(pieces(c), lambda t: F.array_join(F.slice(t, F.greatest(F.lit(1), F.size(t) - overlap + 1), F.lit(overlap)), ""))
        led = lambda k: F.transform(k, lambda c, i: F.when(i == 0, c).otherwise(F.concat(tail(F.get(k, i - 1)), c)))
        kept = _let(kept, led)
    short = n_pieces(text) <= size
    return F.when((strip(text) == "") | text.isNull(), F.array().cast("array<string>")).when(short, F.array(text)).otherwise(kept)


class Tokenizer(Protocol):
    """Columns that depend on what a token is."""

    def count(self, text: Column) -> Column: ...

    def fixed(self, text: Column, size: int, overlap: int) -> Column: ...

    def recursive(self, text: Column, size: int, overlap: int) -> Column: ...


class Pieces:
    """The lossless tokenizer: expressions alone."""

    count = staticmethod(n_pieces)
    fixed = staticmethod(fixed)
    recursive = staticmethod(recursive)


def breaks(vectors: DataFrame, keys: list[str], percentile: float = 95.0) -> DataFrame:
    """Sentences ``keys, _i, vector`` with ``_drop``, 1 - cosine with the one before, and ``_break``: whether it reaches the percentile of its section."""
    order = W.partitionBy(*keys).orderBy("_i")
    drop = vectors.withColumn("_drop", 1 - dot(F.lag("vector").over(order), F.col("vector")))
    limit = F.percentile("_drop", percentile / 100).over(W.partitionBy(*keys))
    return drop.withColumn("_break", F.coalesce(F.col("_drop") >= limit, F.lit(False)))


def semantic(sections: DataFrame, embed, size: int = 512, overlap: int = 64, percentile: float = 95.0, keys: tuple[str, ...] = ("paper_id", "section_index"), tokenizer: Tokenizer | None = None) -> DataFrame:
    """``keys, chunks``: sections cut where neighbouring sentences differ most.

    ``embed(rows, id_cols, text_col)`` gives ``id_cols, vector`` (normalised) for the sentences. A
    break stands where 1 - cosine reaches the percentile of its section (so at least one). Sections
    of two sentences or of ``size`` tokens at most stay whole; segments above it are cut recursively.
    """
    check_sizes(size, overlap)
    if embed is None:
        raise ValueError("semantic chunking needs an embedder")
    if not 50 <= percentile <= 99.5:
        raise ValueError("percentile must be in [50, 99.5]")
    keys, tokenizer = list(keys), tokenizer or Pieces()
    split = sections.select(*keys, "text", sentences(F.col("text")).alias("_s")).withColumn("_whole", (F.size("_s") <= 2) | (tokenizer.count(F.col("text")) <= size))
    whole = split.where("_whole").select(*keys, F.when(strip(F.col("text")) == "", F.array().cast("array<string>")).otherwise(F.array("text")).alias("chunks"))
    each = split.where("NOT _whole").select(*keys, F.posexplode_outer("_s").alias("_i", "_t"))
    vectors = each.join(embed(each, [*keys, "_i"], "_t"), [*keys, "_i"])
    order = W.partitionBy(*keys).orderBy("_i")
    segment = breaks(vectors, keys, percentile).withColumn("_no", F.sum(F.col("_break").cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    joined = segment.groupBy(*keys, "_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_t"))), lambda x: x["_t"]), " ").alias("_c"))
    cut = joined.select(*keys, "_no", tokenizer.recursive(F.col("_c"), size, overlap).alias("_parts"))
    chunks = cut.groupBy(*keys).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("_no", "_parts"))), lambda x: x["_parts"])).alias("chunks"))
    return whole.unionByName(chunks)


def chunk_sections(sections: DataFrame, strategy: str = "recursive", size: int = 512, overlap: int | None = 64, embed=None, percentile: float = 95.0, tokenizer: Tokenizer | None = None) -> DataFrame:
    """Chunks with ``chunk_id`` = paper::section::index. An overlap of 0 or None means the default."""
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    overlap, tokenizer = overlap or 64, tokenizer or Pieces()
    base = ["paper_id", "section_index", "section_title"]
    if strategy == "semantic":
        made = semantic(sections, embed, size, overlap, percentile, tokenizer=tokenizer).join(sections.select(*base), ["paper_id", "section_index"])
    else:
        made = sections.select(*base, (tokenizer.fixed if strategy == "fixed" else tokenizer.recursive)(F.col("text"), size, overlap).alias("chunks"))
    # outer: Spark puts a filter before a plain explode, and so would chunk every text again for it
    each = made.select(*base, F.posexplode_outer("chunks").alias("chunk_index", "text")).where("chunk_index IS NOT NULL")
    return each.select(
        F.concat_ws("::", "paper_id", "section_index", "chunk_index").alias("chunk_id"), *base, "chunk_index", "text", F.length("text").alias("char_count"), tokenizer.count(F.col("text")).alias("token_count"), F.lit(strategy).alias("strategy")
    )


def chunk_stats(sections: DataFrame, chunks: DataFrame) -> DataFrame:
    """``papers, sections, chunks, mean_tokens, median_tokens, p90_tokens, p99_tokens``; zeros if empty.

    p90 and p99 are the values at ``int(q * (n - 1))`` of the sorted counts, by a frequency table of
    the counts, so that no list of all chunks is made.
    """
    inputs = sections.agg(F.count_distinct("paper_id").alias("papers"), F.count("*").alias("sections"))
    freq = chunks.groupBy("token_count").agg(F.count("*").alias("f"))
    upto = F.sum("f").over(W.orderBy("token_count").rowsBetween(W.unboundedPreceding, 0))
    every = F.sum("f").over(W.partitionBy())
    ranked = freq.withColumn("upto", upto).withColumn("n", every)
    at = lambda q: F.min(F.when(F.col("upto") > F.floor(F.lit(q) * (F.col("n") - 1)), F.col("token_count")))
    low = F.min(F.when(F.col("upto") > F.floor((F.col("n") - 1) / 2), F.col("token_count")))
    high = F.min(F.when(F.col("upto") > F.floor(F.col("n") / 2), F.col("token_count")))
    numbers = ranked.agg(
        F.coalesce(F.sum("f"), F.lit(0)).alias("chunks"), F.coalesce(F.round(F.sum(F.col("f") * F.col("token_count")) / F.sum("f"), 1), F.lit(0.0)).alias("mean_tokens"), F.coalesce((low + high) / 2, F.lit(0.0)).alias("median_tokens"),
        F.coalesce(at(0.90), F.lit(0)).alias("p90_tokens"), F.coalesce(at(0.99), F.lit(0)).alias("p99_tokens"),
    )
    return inputs.join(F.broadcast(numbers))
