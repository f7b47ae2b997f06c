"""Calls of a language model for many prompts: each different prompt once, some at a time, again when they fail, and kept.

A reply belongs to the hash of the model's name, its parameters and the prompt. Replies are kept in a
folder, to which every round of prompts is added as it ends, so that a later run, or one that starts
again after it broke off, asks only what is missing. Within a round, what a task has written stays
written when another executor is lost.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.sources.scratch import scratch, stored
from siltstone.sources.tables import exists

_REPLIES = "key string, reply string"


def tried(call: Callable[[], str | None], tries: int, wait: float) -> str | None:
    """The result, or null after ``tries`` failures; the waits between them double."""
    for n in range(tries):
        try:
            return call()
        except Exception:  # any failure of the model may pass
            if n + 1 < tries:
                time.sleep(wait * 2**n)
    return None


@dataclass
class Caller:
    """A model as an operator: ``call(prompt, **params)`` gives the reply and may raise.

    At most ``tasks`` tasks with ``at_once`` calls each run together. A call that raises is made again,
    ``tries`` times in all; one that fails then has a null reply in this run and is asked again in the
    next. ``folder`` keeps the replies (a scratch folder of the session if none is told), and
    ``per_round`` prompts are asked between two additions to it.
    """

    call: Callable[..., str | None]
    name: str = "model"
    params: Mapping[str, object] = field(default_factory=dict)
    folder: str | None = None
    tasks: int = 8
    at_once: int = 8
    tries: int = 5
    wait: float = 1.0
    per_round: int = 10_000

    def key(self, prompt: Column) -> Column:
        told = "\n".join([self.name, *(f"{k}={self.params[k]!r}" for k in sorted(self.params))])
        return F.sha2(F.concat(F.lit(told + "\n\n"), prompt), 256)

    def kept(self, spark: SparkSession) -> DataFrame:
        """``key, reply`` of the replies so far."""
        self.folder = self.folder or scratch(spark)
        if not exists(spark, self.folder):
            return spark.createDataFrame([], _REPLIES)
        # two runs at once may have asked the same
        return spark.read.schema(_REPLIES).parquet(self.folder).groupBy("key").agg(F.min("reply").alias("reply"))

    def replies(self, prompts: DataFrame) -> DataFrame:
        """``key, reply`` for the keys of ``key, prompt``, asked where they are not known."""
        spark = prompts.sparkSession
        wanted = stored(prompts.groupBy("key").agg(F.min("prompt").alias("prompt")))
        missing = wanted.join(self.kept(spark), "key", "left_anti")
        rounds = -(-missing.count() // self.per_round)
        missing = stored(missing) if rounds > 1 else missing
        call, params, at_once, tries, wait = self.call, dict(self.params), self.at_once, self.tries, self.wait

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            with ThreadPoolExecutor(at_once) as pool:
                for batch in batches:
                    prompts = batch["prompt"].to_pylist()
                    got = list(pool.map(lambda p: tried(lambda: call(p, **params), tries, wait), prompts))
                    yield pa.RecordBatch.from_arrays([batch["key"], pa.array(got, pa.string())], ["key", "reply"])

        for r in range(rounds):
            some = missing if rounds == 1 else missing.where(F.pmod(F.xxhash64("key"), F.lit(rounds)) == r)
            asked = some.repartition(self.tasks, "key").mapInArrow(ask, _REPLIES)
            asked.where("reply IS NOT NULL").write.mode("append").parquet(self.folder)
        # a table of its own: within one plan Spark takes two scans of the growing folder for the same
        return stored(wanted.select("key").join(self.kept(spark), "key", "left"))

    def answered(self, rows: DataFrame, prompt: Column, name: str) -> DataFrame:
        """``rows`` with the replies to ``prompt`` as column ``name``; null for a null prompt or a failed call."""
        keyed = rows.withColumn("_key", self.key(prompt))
        replies = self.replies(keyed.where("_key IS NOT NULL").select(F.col("_key").alias("key"), prompt.alias("prompt")))
        return keyed.join(replies.select(F.col("key").alias("_key"), F.col("reply").alias(name)), "_key", "left").drop("_key")


def with_reply(rows: DataFrame, prompt: Column, model: Caller | Callable[[Column], Column], name: str) -> DataFrame:
    """``rows`` with a model's replies as column ``name``, whether the model is a Caller or a column function."""
    return model.answered(rows, prompt, name) if isinstance(model, Caller) else rows.withColumn(name, model(prompt))
