"""Spelling variants by wildcard groups, without pairs of words.

Words are counted in Arrow batches, each task adding up before anything is shuffled. The words of the
vocabulary are then numbered by frequency (ties in code-point order), so that "the most frequent near
word" is the least number, and all that follows moves numbers and 128-bit hashes of constant width,
however long a word is.

Words that differ in one replaced letter share exactly one group (position, prefix, suffix). A group
keeps its size and its two least numbers: a member's near words in it are size - 1, the best of them
the least number that is not its own. A word without one letter is looked up in the vocabulary, which
finds each pair of one inserted or deleted letter once; a letter that repeats its neighbour is deleted
once, as the result is the same. Both kinds are added up by word; no two words of a group ever meet.

A group has at most as many words as the alphabet has letters, so no key is hot after counting. Forms
have five times the count of their word, so chains end; roots come from pointer doubling, in as many
rounds as the largest count allows.

Cases: a null text has no words; a null id counts as an empty string in the hash; repeated rows count
each time; an empty table gives an empty one. Other columns are not looked at.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.llm.common import stored

#: Words of fewer letters, or fewer occurrences, are left out.
LEAST_LETTERS, LEAST_COUNT = 6, 5
#: A form has at least so many times the occurrences of its word.
TIMES = 5
#: One run in so many, by hash of document and run, loses a letter.
DAMAGE = 199
RUN, OTHER = "[a-zÀ-ÿ]", "[^a-zÀ-ÿ]"
#: Characters of a text that are looked at together, and counts that a task holds before it sends them on.
PIECE, HELD = 1 << 22, 300_000


def _pieces(text: str) -> Iterator[str]:
    """The text in parts that end between runs."""
    at, end_of_run = 0, re.compile(OTHER)
    while at < len(text):
        found = end_of_run.search(text, at + PIECE)
        upto = found.start() if found else len(text)
        yield text[at:upto]
        at = upto


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n``: the damaged words of at least LEAST_LETTERS letters with their occurrences."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        long_run, seen = re.compile(f"{RUN}{{{LEAST_LETTERS},}}"), {}

        def send() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
            seen.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch["id"], batch["text"], strict=True):
                start = zlib.crc32(f"{doc.as_py()}:".encode())
                # bytes.lower() changes A-Z alone
                for piece in _pieces((text.as_py() or "").encode().lower().decode()):
                    for word, n in Counter(long_run.findall(piece)).items():
                        h = zlib.crc32(word.encode(), start)
                        if not h % DAMAGE:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < LEAST_LETTERS:
                                continue
                        seen[word] = seen.get(word, 0) + n
                    if len(seen) > HELD:
                        yield send()
        if seen:
            yield send()

    named = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).cast("string").alias("text"))
    return named.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _key(*parts: Column) -> tuple[Column, Column]:
    """128 bits of hash."""
    return F.xxhash64(*parts), F.xxhash64(F.lit("spelling"), *reversed(parts))


def vocabulary(counts: DataFrame) -> DataFrame:
    """``r, word, n``: the words counted often enough, numbered in the order of n, largest first, then word."""
    kept = counts.where((F.col("n") >= LEAST_COUNT) & (F.length("word") >= LEAST_LETTERS)).orderBy(F.col("n").desc(), "word")
    return stored(kept.select(F.monotonically_increasing_id().alias("r"), "word", "n"))


def _shuffled(side: DataFrame) -> DataFrame:
    """A side of a join that is never sent whole: a vocabulary is so well compressed that its file would pass for small, and grow tenfold and more in the driver's memory."""
    return side.hint("merge")


def _replaced(words: DataFrame) -> DataFrame:
    """``r, near, best`` of a word in each of its wildcard groups that has another word."""
    without = lambda i: F.struct(*[k.alias(name) for k, name in zip(_key(F.substring("word", 1, i - 1), F.expr("substring(word, i + 1)"), i), "ab", strict=True)])
    each = words.select("r", "word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("i"))
    keyed = each.select("r", without(F.col("i")).alias("k")).select("r", "k.a", "k.b")
    group = W.partitionBy("a", "b")
    ordered = group.orderBy("r")
    sized = keyed.select("r", (F.count("*").over(group) - 1).alias("near"), F.first("r").over(ordered).alias("top"), F.lead("r").over(ordered).alias("next"))
    return sized.where("near > 0").select("r", "near", F.when(F.col("r") == F.col("top"), F.col("next")).otherwise(F.col("top")).alias("best"))


def _indels(words: DataFrame) -> DataFrame:
    """``r, near, best`` of both words of each pair of which one is the other with one letter less."""
    each = words.where(F.length("word") > LEAST_LETTERS).select("r", "word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("i"))
    once = each.where(F.expr("i = length(word) OR substring(word, i, 1) <> substring(word, i + 1, 1)"))
    shorter = F.concat(F.expr("substring(word, 1, i - 1)"), F.expr("substring(word, i + 1)"))
    a, b = _key(shorter)
    long = once.select(F.col("r").alias("long"), a.alias("a"), b.alias("b"))
    a, b = _key(F.col("word"))
    found = long.join(_shuffled(words.select(F.col("r").alias("short"), a.alias("a"), b.alias("b"))), ["a", "b"])
    both = F.array(F.struct(F.col("long").alias("r"), F.col("short").alias("best")), F.struct(F.col("short").alias("r"), F.col("long").alias("best")))
    return found.select(F.explode(both).alias("x")).select("x.r", F.lit(1).cast("long").alias("near"), "x.best")


def _roots(forms: DataFrame, largest: int) -> DataFrame:
    """``r, root`` of the words that have a form, from ``r, f``."""
    steps = max(1, math.ceil(math.log(max(largest, TIMES), TIMES)))
    now = stored(forms.select("r", F.col("f").alias("root")))
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        on = now.select(F.col("r").alias("root"), F.col("root").alias("further"))
        now = stored(now.join(_shuffled(on), "root", "left").select("r", F.coalesce("further", "root").alias("root")))
    return now


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of each word of the vocabulary.

    ``n_near`` counts the words that differ by one inserted, deleted or replaced letter; ``form`` is
    the most frequent of them if it has TIMES the occurrences, ``root`` the last form of the chain.
    """
    words = vocabulary(count_words(docs, id_col, text_col))
    largest = words.agg(F.max("n")).first()[0]
    near = _replaced(words).unionByName(_indels(words)).groupBy("r").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
    best = words.select(F.col("r").alias("best"), F.col("word").alias("_form"), F.col("n").alias("_n"))
    joined = words.join(_shuffled(near), "r", "left").join(_shuffled(best), "best", "left")
    formed = F.col("_n") >= TIMES * F.col("n")
    told = stored(joined.select("r", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(formed, F.col("best")).alias("f"), F.when(formed, F.col("_form")).alias("form"), F.when(formed, F.col("_n")).alias("form_n")))
    roots = _roots(told.where("f IS NOT NULL").select("r", "f"), largest or 1)
    named = roots.join(_shuffled(words.select(F.col("r").alias("root"), F.col("word").alias("_root"))), "root").select("r", "_root")
    return told.join(_shuffled(named), "r", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("_root", "word").alias("root"))
