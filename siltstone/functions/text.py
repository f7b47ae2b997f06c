"""Text expressions: tokens, matching, sentences, previews. All are Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A lossless split: words, single marks, and runs of white space; joined again they are the text.
PIECE = r"(?U)\w+|[^\w\s]|\s+"


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def terms(text: Column) -> Column:
    """Search terms: lower-cased runs of ASCII letters and digits; other letters separate."""
    return F.regexp_extract_all(F.lower(text), F.lit("[A-Za-z0-9]+"), F.lit(0))


def pieces(text: Column) -> Column:
    """The default tokenizer: an array whose concatenation is the text."""
    return F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))


def n_pieces(text: Column) -> Column:
    return F.regexp_count(text, F.lit(PIECE))


def for_match(text: Column) -> Column:
    """Lower-cased, white space collapsed, stripped: the form in which quotes are compared."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def collapse_breaks(text: Column) -> Column:
    return F.regexp_replace(text, "\n{3,}", "\n\n")


def sentences(text: Column) -> Column:
    """Sentences of each paragraph: a break stands after . ! or ? before white space and a capital."""
    return F.filter(F.flatten(F.transform(F.split(text, "\n\n", -1), lambda p: F.split(strip(p), r"(?<=[.!?])(?U)\s+(?=[A-Z])", -1))), lambda s: strip(s) != "")


def preview(text: Column, chars: int = 200) -> Column:
    return F.replace(F.substring(text, 1, chars), F.lit("\n"), F.lit(" "))
