"""Vector expressions over array columns, in double precision, and the hash-bag embedding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import terms


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero."""
    return F.when((norm(a) == 0) | (norm(b) == 0), F.lit(0.0)).otherwise(dot(a, b) / (norm(a) * norm(b)))


def normalized(a: Column) -> Column:
    return F.when(norm(a) == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / norm(a)))


def hash_bag(rows: DataFrame, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """``id_cols, vector``: a stand-in for a learned embedder, 32 numbers, without a shuffle.

    Each term counts in the bucket of the first byte of its md5, modulo 32; the counts are
    L2-normalised. Texts without terms get the zero vector. A learned model is plugged in as
    ``embed`` instead.
    """
    low, high = "0123456789abcdef", "ghijklmnopqrstuv"  # a bucket's letter: the second digit, by the first one's parity
    digests = F.transform(terms(F.coalesce(F.col(text_col), F.lit(""))), lambda t: F.md5(t))
    digit = lambda m: F.substring(m, 2, 1)
    letters = F.transform(digests, lambda m: F.when(F.substring(m, 1, 1).isin(*low[::2]), digit(m)).otherwise(F.translate(digit(m), low, high)))
    once = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)  # noqa: E731  worked out once, however often it is used
    counts = lambda s: F.array(*[(F.length(s) - F.length(F.replace(s, F.lit(c), F.lit("")))).cast("double") for c in low + high])
    unit = lambda v: once(norm(v), lambda n: F.when(n == 0, v).otherwise(F.transform(v, lambda x: x / n)))
    return rows.select(*id_cols, once(once(F.array_join(letters, ""), counts), unit).alias("vector"))
