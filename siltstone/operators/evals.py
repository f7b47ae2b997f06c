"""Evaluation sets from chunks, and the judging of answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.replies import first_flat_object, json_object, number_field, text_field, texts, truthy
from siltstone.functions.text import strip
from siltstone.functions.vectors import cosine
from siltstone.operators.calls import with_reply
from siltstone.operators.grounding import Model
from siltstone.operators.rewrite import fill

SINGLE_HOP = "Write one question that the passage answers, and its answer. Reply with one JSON object with the keys question, gold_answer and confidence (0 to 1).\n\nPassage: {text}"
NO_ANSWER = "Write one question on the passage's subject that the passage does not answer, and why. Reply with one JSON object with the keys question, gold_answer and confidence (0 to 1).\n\nPassage: {text}"
CLAIMS = "List the claims of the answer below, each standing alone, as a JSON array of strings.\n\nQuestion: {question}\nAnswer: {answer}"
VERDICT = 'Does the context support the claim? Reply with {"supported": true} or {"supported": false}.\n\nContext: {context}\nClaim: {claim}'
REVERSE = "Write {n} questions that the answer below would answer, as a JSON array of strings.\n\nAnswer: {answer}"


def seeded_sample(rows: DataFrame, n: int, seed: int, id_col: str = "chunk_id") -> DataFrame:
    """n rows in the order of md5(seed:id); all of them if there are no more."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"))), id_col).limit(n)


def reject_reason(question: Column, answer: Column, confidence: Column, text: Column, min_confidence: float = 0.6, min_question: int = 15, min_answer: int = 20) -> Column:
    """The first failed check, or null for an item to keep."""
    # The five reasons.
    return (
        F.when(confidence < min_confidence, F.format_string("low confidence (%.2f)", confidence))
        .when(F.length(question) < min_question, "question too short")
        .when(F.length(answer) < min_answer, "answer too short")
        .when(~question.endswith("?"), "question doesn't end with '?'")
        .when(F.contains(F.lower(text), F.lower(question)), "question is a direct quote from chunk")
    )


def read_items(sampled: DataFrame, kind: str, prefix: str, min_confidence: float = 0.6, min_question: int = 15, min_answer: int = 20) -> DataFrame:
    """Items from ``no, chunk_id, paper_id, text, raw``: ids by the place in the sample, with a ``reason`` where an item is not kept."""
    got = sampled.withColumn("_o", first_flat_object(F.col("raw")))
    read = got.select("no", "chunk_id", "paper_id", "text", "raw", F.col("_o").isNotNull().alias("_ok"), text_field(F.col("_o"), "$.question").alias("question"), text_field(F.col("_o"), "$.gold_answer").alias("gold_answer"), number_field(F.col("_o"), "$.confidence").alias("confidence"))
    reason = F.when(F.col("raw").isNull(), "error").when(~F.col("_ok"), "parse failed").otherwise(reject_reason(F.col("question"), F.col("gold_answer"), F.col("confidence"), F.col("text"), min_confidence, min_question, min_answer))
    return read.select(
        F.format_string(f"{prefix}-%04d", "no").alias("id"), "question", "gold_answer", F.lit(kind).alias("type"), F.col("paper_id").alias("source_paper_id"), F.array("chunk_id").alias("source_chunk_ids"),
        F.format_string("confidence=%.2f", "confidence").alias("notes"), reason.alias("reason"),
    )


def generate_eval_set(chunks: DataFrame, model: Model, n_single_hop: int = 200, n_no_answer: int = 30, seed: int = 42, min_tokens: int = 100, min_confidence: float = 0.6, min_question: int = 15, min_answer: int = 20) -> DataFrame:
    """All generated items with their ``reason``; those to keep have none. Without a long enough chunk ValueError."""
    from pyspark.sql import Window as W

    usable = chunks.where(F.col("token_count") >= min_tokens)
    if not usable.take(1):
        raise ValueError(f"no chunk has {min_tokens} tokens")
    out = []
    for kind, prefix, template, n, s in (("single_hop", "sh", SINGLE_HOP, n_single_hop, seed), ("no_answer", "na", NO_ANSWER, n_no_answer, seed + 1)):
        key = F.md5(F.concat(F.lit(f"{s}:"), F.col("chunk_id")))
        sampled = seeded_sample(usable, n, s).withColumn("no", F.row_number().over(W.orderBy(key, "chunk_id")) - 1)
        out.append(read_items(with_reply(sampled, fill(template, text=F.col("text")), model, "raw"), kind, prefix, min_confidence, min_question, min_answer))
    return out[0].unionByName(out[1])


def counters(items: DataFrame) -> DataFrame:
    """``generated, kept, filtered_parse_failed, filtered_low_confidence, filtered_other, errors``."""
    r = F.col("reason")
    low, parse, error = r.startswith("low confidence"), r == "parse failed", r == "error"
    return items.agg(
        F.count("*").alias("generated"), F.count_if(r.isNull()).alias("kept"), F.count_if(parse).alias("filtered_parse_failed"), F.count_if(low).alias("filtered_low_confidence"),
        F.count_if(r.isNotNull() & ~low & ~parse & ~error).alias("filtered_other"), F.count_if(error).alias("errors"),
    )


def claims(replies: DataFrame) -> DataFrame:
    """``id, pos, claim`` from replies ``id, raw``."""
    return replies.select("id", F.posexplode(F.coalesce(texts(F.col("raw")), F.array().cast("array<string>"))).alias("pos", "claim"))


def supported(raw: Column) -> Column:
    """A verdict; unreadable ones count as unsupported."""
    return F.coalesce(truthy(F.try_variant_get(json_object(raw), "$.supported", "variant")), F.lit(False))


def faithfulness(answers: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``id, n_claims, n_supported, faithfulness`` from ``id`` and ``id, supported``; without claims 1."""
    each = verdicts.groupBy("id").agg(F.count("*").alias("n_claims"), F.count_if("supported").alias("n_supported"))
    joined = answers.select("id").join(each, "id", "left")
    zero = F.lit(0).cast("long")
    return joined.select("id", F.coalesce("n_claims", zero).alias("n_claims"), F.coalesce("n_supported", zero).alias("n_supported"), F.round(F.coalesce(F.col("n_supported") / F.col("n_claims"), F.lit(1.0)), 6).alias("faithfulness"))


def judge_faithfulness(answered: DataFrame, model: Model) -> DataFrame:
    """``id, n_claims, n_supported, faithfulness`` of answers ``id, question, answer, context``, judged by a model.

    One call lists an answer's claims, and one more for each claim says whether the context supports
    it. A failed or broken list is a list without claims, a failed or broken verdict no support; blank
    answers are not asked about.
    """
    asked = answered.where(strip(F.coalesce("answer", F.lit(""))) != "").select("id", "question", "answer")
    listed = with_reply(asked, fill(CLAIMS, question=F.col("question"), answer=F.col("answer")), model, "raw")
    each = claims(listed).join(answered.select("id", "context"), "id")
    said = with_reply(each, fill(VERDICT, context=F.coalesce("context", F.lit("")), claim=F.col("claim")), model, "raw")
    verdicts = said.select("id", supported(F.col("raw")).alias("supported"))
    return faithfulness(answered, verdicts)


def judge_relevance(answered: DataFrame, model: Model, embed: Callable[[DataFrame, list[str], str], DataFrame], n: int = 3) -> DataFrame:
    """``id, n_questions, relevance`` of answers ``id, question, answer``: a model writes up to n questions that the answer would answer, whose vectors are compared with the question's."""
    asked = answered.where(strip(F.coalesce("answer", F.lit(""))) != "").select("id", "answer")
    reverse = with_reply(asked, fill(REVERSE, n=F.lit(str(n)), answer=F.col("answer")), model, "raw").select("id", F.posexplode(F.slice(F.coalesce(texts(F.col("raw")), F.array().cast("array<string>")), 1, max(0, n))).alias("no", "text"))
    return answer_relevance(embed(answered.select("id", F.col("question").alias("text")), ["id"], "text"), embed(reverse, ["id", "no"], "text"))


def judge(answered: DataFrame, model: Model, embed: Callable[[DataFrame, list[str], str], DataFrame], n: int = 3) -> DataFrame:
    """Answers ``id, question, answer, context, abstained`` with their ``faithfulness`` and ``relevance``.

    An abstention is faithful without asking; its relevance is judged as that of any answer.
    """
    claimed = judge_faithfulness(answered.where(~F.col("abstained")), model)
    scored = answered.join(claimed, "id", "left").join(judge_relevance(answered, model, embed, n), "id", "left")
    zero = F.lit(0).cast("long")
    return scored.select(
        "id", "question", "answer", "abstained", F.coalesce("n_claims", zero).alias("n_claims"), F.coalesce("n_supported", zero).alias("n_supported"),
        F.coalesce("faithfulness", F.lit(1.0)).alias("faithfulness"), F.coalesce("relevance", F.lit(0.0)).alias("relevance"),
    )


def answer_relevance(questions: DataFrame, reverse: DataFrame) -> DataFrame:
    """``id, n_questions, relevance``: mean cosine of a question's ``vector`` with those of its reverse questions; none gives 0."""
    pairs = reverse.select("id", F.col("vector").alias("_r")).join(questions.select("id", F.col("vector").alias("_q")), "id")
    each = pairs.groupBy("id").agg(F.count("*").alias("n_questions"), F.avg(cosine(F.col("_q"), F.col("_r"))).alias("_m"))
    return questions.select("id").join(each, "id", "left").select("id", F.coalesce("n_questions", F.lit(0).cast("long")).alias("n_questions"), F.round(F.coalesce("_m", F.lit(0.0)), 6).alias("relevance"))


def run_means(scored: DataFrame) -> DataFrame:
    """``n, n_abstained`` and the means of ``faithfulness`` and ``relevance`` over all and over answered items (0 if none).

    An abstention counts as faithful.
    """
    f = F.when(F.col("abstained"), 1.0).otherwise(F.col("faithfulness"))
    answered = lambda c: F.round(F.coalesce(F.avg(F.when(~F.col("abstained"), F.col(c))), F.lit(0.0)), 6)
    return scored.agg(
        F.count("*").alias("n"), F.count_if("abstained").alias("n_abstained"), F.round(F.avg(f), 6).alias("mean_faithfulness"), F.round(F.avg("relevance"), 6).alias("mean_relevance"),
        answered("faithfulness").alias("answered_faithfulness"), answered("relevance").alias("answered_relevance"),
    )
