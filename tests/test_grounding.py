import json

import pytest
from pyspark.sql import functions as F

from siltstone.functions import replies
from siltstone.operators import evals, grounding

TEXT = "Dense retrieval embeds passages and questions in one space.\nIt needs   no index of terms."
QUOTE = "embeds passages and questions"


def one(spark, values, f, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"x {kind}").select(f(F.col("x"))).collect()]


def test_quotes(spark):
    quotes = [QUOTE, QUOTE.upper(), "one space. it\n needs no index", "embeds passages and answers", "embeds", "", None, "   embeds      "]
    rows = spark.createDataFrame([(q, TEXT) for q in quotes], "q string, t string")
    assert [r[0] for r in rows.select(grounding.quoted(F.col("q"), F.col("t"))).collect()] == [True, True, True, False, False, False, False, False]


def test_replies(spark):
    text = lambda c: F.to_json(c)
    raws = ['{"a": 1}', '```json\n{"a": 1}\n```', 'Sure: {"a": 1} done', "[1]", "{broken", "", None, "{'a': 1}"]
    assert one(spark, raws, lambda c: text(replies.json_object(c))) == ['{"a":1}'] * 3 + [None] * 5
    assert one(spark, ['x ["a", 1, "", " b "] y', "none", '["1", 1]'], replies.strings) == [["a", "b"], [], ["1"]]
    assert one(spark, ['["a", 1, ""]', "none", "[]"], replies.texts) == [["a", "1"], None, []]
    assert one(spark, ['x {"q": {"r": 1}} {"s": 2}', "none"], lambda c: text(replies.first_flat_object(c))) == ['{"r":1}', None]
    values = ["true", "false", '"false"', '""', "0", "2", "null", "[]", "[0]", "{}", '{"a":1}']
    assert one(spark, values, lambda c: replies.truthy(F.try_parse_json(c))) == [True, False, True, False, False, True, False, False, True, False, True]
    assert one(spark, ['{"c": "0.7"}', '{"c": 1}', '{"c": "x"}', "{}"], lambda c: replies.number_field(F.try_parse_json(c), "$.c")) == [0.7, 1.0, 0.0, 0.0]


def answers(spark, raw, contexts=(("c1", TEXT), ("c2", "Other passage, about something else entirely."))):
    q = spark.createDataFrame([(1, "What is it?")], "query_id int, question string")
    c = spark.createDataFrame([(1, i, t) for i, t in contexts], "query_id int, chunk_id string, text string")
    return grounding.answers(q, c, spark.createDataFrame([(1, raw)], "query_id int, raw string")).first()


def reply(cited, answer=" Yes. ", abstained=False):
    return json.dumps({"answer": answer, "abstained": abstained, "citations": cited})


def test_verified_answers(spark):
    good, fake = {"chunk_id": "c1", "supporting_quote": QUOTE}, {"chunk_id": "c1", "supporting_quote": "made up words that are not there"}
    r = answers(spark, reply([fake, good, good, "no object", {"chunk_id": "c9", "supporting_quote": QUOTE}]))
    assert (r["answer"], r["abstained"], [tuple(c) for c in r["citations"]]) == ("Yes.", False, [("c1", QUOTE)])
    assert answers(spark, reply([good], abstained=True))["abstained"] and len(answers(spark, reply([good], abstained=True))["citations"]) == 1


@pytest.mark.parametrize("raw,answer", [(reply([]), "Yes."), (reply([], ""), grounding.UNGROUNDED), ("no json", grounding.BROKEN), (None, grounding.NO_CALL), ('{"answer": "A", "citations": "x"}', "A")])
def test_abstentions(spark, raw, answer):
    r = answers(spark, raw)
    assert (r["answer"], r["abstained"], r["citations"]) == (answer, True, [])


def test_no_context_and_model_calls(spark):
    assert answers(spark, None, ())["answer"] == grounding.NO_CONTEXT
    q = spark.createDataFrame([(1, "What is it?"), (2, "Alone?")], "query_id int, question string")
    c = spark.createDataFrame([(1, 1, "c1", "Intro", TEXT)], "query_id int, rank int, chunk_id string, section_title string, text string")

    def model(prompt):
        if "What is it?" not in prompt or "chunk_id: c1" not in prompt:
            raise RuntimeError
        return reply([{"chunk_id": "c1", "supporting_quote": QUOTE}])

    got = {r["query_id"]: r for r in grounding.generate(q, c, grounding.pandas_model(model)).collect()}
    assert not got[1]["abstained"] and got[2]["answer"] == grounding.NO_CONTEXT
    rates = grounding.refusal_rates(spark.createDataFrame([(True, []), (False, [1]), (True, [1]), (True, [])], "abstained boolean, citations array<int>")).first()
    assert tuple(rates) == (4, 0.75, 0.25)


def test_context_format(spark):
    hits = spark.createDataFrame([([("c1", "Intro", "abc"), ("c2", "End", "x" * 20)],)], "h array<struct<chunk_id: string, section_title: string, text: string>>")
    assert hits.select(grounding.context(F.col("h"), 10)).first()[0] == "[1] chunk_id: c1\n    section: Intro\n    text: abc\n\n[2] chunk_id: c2\n    section: End\n    text: " + "x" * 10 + "..."


def test_quality_filter_cascade(spark):
    text = "what is the meaning of this passage? nothing much."
    rows = [("Why is the sky blue today?", "Because of the scattering of light.", 0.9, None), ("Why is the sky blue today?", "short", 0.5, "low confidence (0.50)"), ("Why?", "short", 0.9, "question too short"),
            ("Why is the sky blue today?", "short", 0.9, "answer too short"), ("Tell me of the sky today", "Because of the scattering of light.", 0.9, "question doesn't end with '?'"),
            ("What is the meaning of THIS passage?", "Because of the scattering of light.", 0.6, "question is a direct quote from chunk")]
    got = spark.createDataFrame([(*r[:3], text) for r in rows], "q string, a string, c double, t string").select(evals.reject_reason(F.col("q"), F.col("a"), F.col("c"), F.col("t"))).collect()
    assert [r[0] for r in got] == [r[3] for r in rows]


def test_generated_items(spark):
    chunks = spark.createDataFrame([(f"c{i}", "p", f"text {i}", 100 + i) for i in range(12)] + [("short", "p", "x", 9)], "chunk_id string, paper_id string, text string, token_count int")
    good = json.dumps({"question": "What does the passage tell us?", "gold_answer": "It tells us a number of things.", "confidence": "0.85"})
    replies_of = {"text 0": "broken", "text 1": None, "text 2": good.replace("0.85", "0.1"), "text 3": good.replace("?", "")}
    names = sorted(replies_of, key=len)

    def model(prompt):
        out = F.lit(f"Here: {good}")
        for n in names:
            out = F.when(prompt.endswith(n), F.lit(replies_of[n])).otherwise(out)
        return out

    items = evals.generate_eval_set(chunks, model, 50, 3)
    rows = items.collect()
    assert len(rows) == 15 and {r["id"][:3] for r in rows} == {"sh-", "na-"} and all(r["source_chunk_ids"] != ["short"] for r in rows)
    single = evals.counters(items.where("type = 'single_hop'")).first()
    assert tuple(single) == (12, 8, 1, 1, 1, 1)
    assert {r["notes"] for r in rows if r["reason"] is None} == {"confidence=0.85"}
    again = evals.generate_eval_set(chunks.repartition(3), model, 50, 3).collect()
    assert sorted(r["id"] + r["source_chunk_ids"][0] for r in again) == sorted(r["id"] + r["source_chunk_ids"][0] for r in rows)
    with pytest.raises(ValueError):
        evals.generate_eval_set(chunks, model, min_tokens=999)


def test_faithfulness_and_relevance(spark):
    listed = evals.claims(spark.createDataFrame([(1, '["a", "b", 3]'), (2, "none"), (3, "[]")], "id int, raw string"))
    assert sorted(map(tuple, listed.collect())) == [(1, 0, "a"), (1, 1, "b"), (1, 2, "3")]
    verdicts = listed.withColumn("raw", F.when(F.col("claim") == "b", F.lit("???")).otherwise(F.lit('{"supported": true}'))).select("id", evals.supported(F.col("raw")).alias("supported"))
    got = evals.faithfulness(spark.createDataFrame([(1,), (2,), (3,)], "id int"), verdicts).collect()
    assert {r["id"]: r["faithfulness"] for r in got} == {1: 0.666667, 2: 1.0, 3: 1.0}
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0])], "id int, vector array<double>")
    r = spark.createDataFrame([(1, [2.0, 0.0]), (1, [0.0, 0.0]), (1, [0.0, 1.0])], "id int, vector array<double>")
    assert {x["id"]: x["relevance"] for x in evals.answer_relevance(q, r).collect()} == {1: 0.333333, 2: 0.0}
    scored = spark.createDataFrame([(0.5, 0.4, False), (0.2, 0.0, True)], "faithfulness double, relevance double, abstained boolean")
    assert tuple(evals.run_means(scored).first()) == (2, 1, 0.75, 0.2, 0.5, 0.4)
    assert tuple(evals.run_means(scored.where("abstained")).first())[4:] == (0.0, 0.0)
