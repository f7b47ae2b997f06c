"""Answers from retrieved chunks: prompts, replies, verified citations, and abstention."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions.replies import elements, json_object, text_field, truthy
from siltstone.functions.text import for_match, strip
from siltstone.operators.calls import Caller, tried, with_reply

PROMPT = (
    "Answer the question from the passages only. Reply with one JSON object with the keys answer (text), abstained (true if the passages do not answer it) and citations "
    "(a list of objects with chunk_id and supporting_quote, copied word for word).\n\nPassages:\n{context}\n\nQuestion: {question}"
)
#: prompt -> reply, as a column function or as a Caller; null stands for a failed call.
Model = Callable[[Column], Column] | Caller
NO_CONTEXT = "(no passages were retrieved)"
NO_CALL = "(the model call failed)"
BROKEN = "(the reply was no valid JSON)"
UNGROUNDED = "(the passages give no verifiable grounding)"


def pandas_model(call: Callable[[str], str | None], at_once: int = 8, tries: int = 5, wait: float = 1.0) -> Model:
    """A model call as a column function: of an Arrow batch, different prompts once, ``at_once`` together.

    A call that raises is made again, ``tries`` times in all, then it gives null. A Caller also keeps replies.
    """

    def replies(prompts: pd.Series) -> pd.Series:
        different = prompts.dropna().unique()
        with ThreadPoolExecutor(at_once) as pool:
            got = dict(zip(different, pool.map(lambda p: tried(lambda: call(p), tries, wait), different), strict=True))
        return prompts.map(got).astype(object).where(prompts.notna(), None)

    return F.pandas_udf(replies, "string").asNondeterministic()


def context(hits: Column, chars: int = 1500) -> Column:
    """Numbered passages from array<struct<chunk_id, section_title, text>>, each cut at ``chars``."""
    cut = lambda t: F.when(F.length(t) > chars, F.concat(F.substring(t, 1, chars), F.lit("..."))).otherwise(t)
    one = lambda h, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] chunk_id: "), h["chunk_id"], F.lit("\n    section: "), h["section_title"], F.lit("\n    text: "), cut(h["text"]))
    return F.array_join(F.transform(hits, one), "\n\n")


def quoted(quote: Column, text: Column, least: int = 15) -> Column:
    """Whether a quote of at least ``least`` characters stands in the text, whatever its case and white space."""
    return F.coalesce((F.length(strip(quote)) >= least) & F.contains(for_match(text), for_match(quote)), F.lit(False))


def citations(replies: DataFrame) -> DataFrame:
    """``query_id, pos, chunk_id, supporting_quote`` of the citation objects of parsed replies (``query_id, reply``)."""
    listed = F.coalesce(F.try_variant_get("reply", "$.citations", "variant"), F.try_parse_json(F.lit("[]")))
    each = replies.select("query_id", F.posexplode(elements(F.when(F.schema_of_variant(listed).startswith("ARRAY"), listed))).alias("pos", "c"))
    objects = each.where(F.schema_of_variant("c").startswith("OBJECT"))
    return objects.select("query_id", "pos", text_field(F.col("c"), "$.chunk_id").alias("chunk_id"), text_field(F.col("c"), "$.supporting_quote").alias("supporting_quote"))


def verified(cited: DataFrame, contexts: DataFrame, least: int = 15) -> DataFrame:
    """The citations of known chunks whose quote stands in the whole chunk; of each chunk the first such."""
    known = cited.join(contexts.select("query_id", "chunk_id", "text"), ["query_id", "chunk_id"])
    good = known.where(quoted(F.col("supporting_quote"), F.col("text"), least))
    first = F.row_number().over(W.partitionBy("query_id", "chunk_id").orderBy("pos"))
    return good.withColumn("_n", first).where("_n = 1").select("query_id", "pos", "chunk_id", "supporting_quote")


def answers(questions: DataFrame, contexts: DataFrame, replies: DataFrame, least: int = 15) -> DataFrame:
    """``query_id, question, answer, citations, abstained, raw_response`` for each question.

    ``contexts`` has ``query_id, chunk_id, text`` and ``replies`` ``query_id, raw``. A question without
    context, reply, parsable reply or verified citation is an abstention, whatever the reply says; a
    reply that abstains with verified citations keeps both.
    """
    parsed = replies.select("query_id", "raw", json_object(F.col("raw")).alias("reply"))
    good = verified(citations(parsed.where("reply IS NOT NULL")), contexts, least)
    grouped = good.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "chunk_id", "supporting_quote"))), lambda c: F.struct(c["chunk_id"].alias("chunk_id"), c["supporting_quote"].alias("supporting_quote"))).alias("citations"))
    held = contexts.groupBy("query_id").agg(F.count("*").alias("_n"))
    said = parsed.select("query_id", "raw", F.col("reply").isNotNull().alias("_ok"), text_field(F.col("reply"), "$.answer").alias("_said"), F.coalesce(truthy(F.try_variant_get("reply", "$.abstained", "variant")), F.lit(False)).alias("_abstained"))
    joined = questions.select("query_id", "question").join(held, "query_id", "left").join(said, "query_id", "left").join(grouped, "query_id", "left")
    none = F.coalesce(F.size("citations"), F.lit(0)) < 1
    ok = F.coalesce(F.col("_ok"), F.lit(False))
    answer = (
        F.when(F.col("_n").isNull(), NO_CONTEXT).when(F.col("raw").isNull(), NO_CALL).when(~ok, BROKEN).when(none & (F.col("_said") == ""), UNGROUNDED).otherwise(F.col("_said"))
    )
    empty = F.array().cast("array<struct<chunk_id:string,supporting_quote:string>>")
    return joined.select("query_id", "question", answer.alias("answer"), F.coalesce("citations", empty).alias("citations"), (none | F.coalesce("_abstained", F.lit(True))).alias("abstained"), F.col("raw").alias("raw_response"))


def generate(questions: DataFrame, contexts: DataFrame, model: Model, chars: int = 1500, least: int = 15) -> DataFrame:
    """Prompt, call and verify. ``contexts`` also has ``rank`` and ``section_title``; questions without context are not asked."""
    from siltstone.operators.rewrite import fill

    hits = contexts.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "chunk_id", "section_title", "text"))), lambda h: F.struct(h["chunk_id"].alias("chunk_id"), h["section_title"].alias("section_title"), h["text"].alias("text"))).alias("hits"))
    asked = questions.join(hits, "query_id").select("query_id", fill(PROMPT, context=context(F.col("hits"), chars), question=F.col("question")).alias("prompt"))
    return answers(questions, contexts, with_reply(asked, F.col("prompt"), model, "raw").select("query_id", "raw"), least)


def refusal_rates(results: DataFrame) -> DataFrame:
    """``n, refusal_accuracy, false_grounding_rate`` over answers to questions that have none."""
    grounded = ~F.col("abstained") & (F.size("citations") > 0)
    return results.agg(F.count("*").alias("n"), F.avg(F.col("abstained").cast("int")).alias("refusal_accuracy"), F.avg(grounded.cast("int")).alias("false_grounding_rate"))
