"""Which passages stand word for word in which texts: one pass over the texts for a block of passages.

Different passages are gathered in blocks of about BLOCK_CHARS characters; an automaton of a block's
passages is built in each task and reads each text once, whatever the number of passages. Matches are
exact. Equal passages are one in the automaton, and each id gets the texts found afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from siltstone.sources.scratch import stored

#: Characters of the passages of one automaton, on average.
BLOCK_CHARS = 1 << 20


def _blocks(passages: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The different passages in blocks by hash, each with its number."""
    size = passages.agg(F.coalesce(F.sum(F.length("text") + 1), F.lit(0))).first()[0]
    n = -(-size // BLOCK_CHARS)
    for b in range(n):
        table = (passages if n == 1 else passages.where(F.pmod(F.xxhash64("key"), F.lit(n)) == b)).select("no", "text").toArrow()
        if table.num_rows:
            yield list(zip(table["no"].to_pylist(), table["text"].to_pylist(), strict=True))


def containing(passages: DataFrame, texts: DataFrame, passage_id: str = "query_id", passage_col: str = "text", text_id: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """``query_id, chunk_id`` of each passage and text that holds it; an empty passage stands in every text, null ones and null texts in none.

    The passages are read by the driver block by block, the texts by all tasks, once a block.
    """
    spark, kind = texts.sparkSession, texts.schema[text_id].dataType
    known = passages.select(F.col(passage_id).alias("query_id"), F.col(passage_col).cast("string").alias("text"), F.md5(F.col(passage_col).cast("string")).alias("key")).where("text IS NOT NULL")
    each = stored(known.groupBy("key").agg(F.min("text").alias("text")).withColumn("no", F.monotonically_increasing_id()))
    named = texts.select(F.col(text_id).alias("chunk_id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    schema, type_ = f"no long, chunk_id {kind.simpleString()}", to_arrow_type(kind)
    out = spark.createDataFrame([], schema)
    for block in _blocks(each):
        sent = spark.sparkContext.broadcast(block)

        def find(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            automaton, everywhere = ahocorasick.Automaton(), {no for no, text in sent.value if not text}
            for no, text in sent.value:
                if text:
                    automaton.add_word(text, no)
            automaton.make_automaton()
            for batch in batches:
                numbers, rows = [], []
                for i, text in enumerate(t for at in range(0, batch.num_rows, 64) for t in batch["text"].slice(at, 64).to_pylist()):  # few texts at once
                    found = everywhere | ({no for _, no in automaton.iter(text)} if len(automaton) else set())
                    numbers += found
                    rows += [i] * len(found)
                yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), batch["chunk_id"].take(pa.array(rows, pa.int64())).cast(type_)], ["no", "chunk_id"])

        out = out.unionByName(named.mapInArrow(find, schema))
    return out.join(each.select("no", "key"), "no").join(known.select("key", "query_id"), "key").select("query_id", "chunk_id")
