"""Model calls: once for equal prompts, again when they fail, kept between runs, some at a time."""

import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from siltstone import cli
from siltstone.operators import calls, evals, grounding


def noted(folder, prompt):
    """A call leaves a file, so that calls of all tasks can be counted."""
    name = f"{folder}/{abs(hash(prompt))}-{os.getpid()}-{threading.get_ident()}-{time.monotonic_ns()}"
    with open(name, "w") as f:
        f.write(prompt)


def count(folder):
    return sorted(open(f"{folder}/{f}").read() for f in os.listdir(folder))


@pytest.fixture
def log(tmp_path):
    (tmp_path / "log").mkdir()
    return str(tmp_path / "log")


def test_equal_prompts_are_asked_once_and_kept(spark, tmp_path, log):
    def call(prompt):
        noted(log, prompt)
        return prompt.upper()

    rows = spark.createDataFrame([(i, f"p{i % 3}") for i in range(30)] + [(99, None)], "id int, prompt string")
    caller = calls.Caller(call, folder=f"{tmp_path}/replies", wait=0.0)
    got = {r.id: r.raw for r in caller.answered(rows, F.col("prompt"), "raw").collect()}
    assert got == {i: f"P{i % 3}" for i in range(30)} | {99: None} and count(log) == ["p0", "p1", "p2"]
    more = rows.unionByName(spark.createDataFrame([(100, "new")], "id int, prompt string"))
    again = calls.Caller(call, folder=f"{tmp_path}/replies", wait=0.0)
    assert {r.id: r.raw for r in again.answered(more, F.col("prompt"), "raw").collect()} == got | {100: "NEW"}
    assert count(log) == ["new", "p0", "p1", "p2"]
    other = calls.Caller(call, name="other", folder=f"{tmp_path}/replies", wait=0.0)
    other.answered(rows, F.col("prompt"), "raw").collect()
    assert len(count(log)) == 7, "another model's replies are its own"
    warm = calls.Caller(lambda p, temperature: f"{p}{temperature}", params={"temperature": 0.3}, folder=f"{tmp_path}/replies")
    assert warm.answered(rows, F.col("prompt"), "raw").where("id = 1").first().raw == "p10.3"


def test_failures_are_tried_again_then_null_and_asked_in_the_next_run(spark, tmp_path, log):
    def call(prompt):
        noted(log, prompt)
        tries = sum(open(f"{log}/{f}").read() == prompt for f in os.listdir(log))
        if prompt == "never" or (prompt == "third" and tries < 3):
            raise RuntimeError("busy")
        return None if prompt == "silent" else "ok"

    rows = spark.createDataFrame([("third",), ("never",), ("silent",), ("fine",)], "prompt string")
    ask = lambda: {r.prompt: r.raw for r in calls.Caller(call, folder=f"{tmp_path}/replies", wait=0.0, tries=4).answered(rows, F.col("prompt"), "raw").collect()}
    assert ask() == {"third": "ok", "never": None, "silent": None, "fine": "ok"}
    assert [count(log).count(p) for p in ("third", "never", "fine")] == [3, 4, 1]
    assert ask()["never"] is None and [count(log).count(p) for p in ("third", "never", "fine")] == [3, 8, 1]


def test_a_run_that_breaks_off_asks_only_what_is_missing(spark, tmp_path, log, monkeypatch):
    def call(prompt):
        noted(log, prompt)
        return "ok"

    rows = spark.createDataFrame([(f"p{i}",) for i in range(40)], "prompt string")
    caller = calls.Caller(call, folder=f"{tmp_path}/replies", per_round=10, wait=0.0)
    real, rounds = type(rows).repartition, []

    def breaks(self, *a):
        rounds.append(1)
        if len(rounds) == 3:
            raise KeyboardInterrupt
        return real(self, *a)

    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        m.setattr(type(rows), "repartition", breaks)
        caller.answered(rows, F.col("prompt"), "raw")
    before = len(count(log))
    assert 0 < before < 40
    assert caller.answered(rows, F.col("prompt"), "raw").where("raw = 'ok'").count() == 40
    assert len(count(log)) == 40


def test_calls_at_once_are_bounded(spark, tmp_path, log):
    def call(prompt):
        begun = time.monotonic_ns()
        time.sleep(0.05)
        noted(log, f"{begun} {time.monotonic_ns()}")
        return "ok"

    rows = spark.createDataFrame([(f"p{i}",) for i in range(24)], "prompt string")
    calls.Caller(call, tasks=1, at_once=3).answered(rows, F.col("prompt"), "raw").collect()
    spans = [tuple(map(int, s.split())) for s in count(log)]
    assert max(sum(a <= x < b for a, b in spans) for x, _ in spans) == 3


def test_column_function_tries_again(spark, log):
    def call(prompt):
        noted(log, prompt)
        if len(count(log)) < 3:
            raise RuntimeError("busy")
        return prompt + "!"

    rows = spark.createDataFrame([("a",), ("a",), (None,)], "p string").coalesce(1)
    assert [r[0] for r in rows.select(grounding.pandas_model(call, wait=0.0)(F.col("p"))).collect()] == ["a!", "a!", None]
    assert count(log) == ["a", "a", "a"]


def test_abstentions_are_judged_for_relevance_alone(spark, log, tmp_path):
    from siltstone.functions.vectors import hash_bag

    def call(prompt):
        noted(log, prompt)
        return '["What is asked here?"]' if prompt.startswith("Write") else '["a claim"]' if prompt.startswith("List") else '{"supported": true}'

    rows = spark.createDataFrame([("1", "What is asked here?", "An answer.", "context", False), ("2", "What is asked here?", "No answer in the passages.", "", True)], "id string, question string, answer string, context string, abstained boolean")
    got = {r.id: r for r in evals.judge(rows, calls.Caller(call), hash_bag, 2).collect()}
    assert (got["2"].faithfulness, got["2"].n_claims, got["2"].relevance) == (1.0, 0, 1.0)
    assert (got["1"].faithfulness, got["1"].n_claims, got["1"].relevance) == (1.0, 1, 1.0)
    assert sum(p.startswith("List") for p in count(log)) == 1 and sum(p.startswith("Write") for p in count(log)) == 2


def test_ragas_takes_single_hop_items_alone(spark, tmp_path):
    import json

    rows = [("p::0::0", "p", "s", "Sparse retrieval scores terms.", "fixed", 120)]
    spark.createDataFrame(rows, "chunk_id string, paper_id string, section_title string, text string, strategy string, token_count int").write.parquet(f"{tmp_path}/chunks")
    cli.main(["index", "--chunks", f"{tmp_path}/chunks", "--out", f"{tmp_path}/index"], spark)
    items = [{"id": str(i), "question": "What scores terms?", "gold_answer": "x", "type": t, "source_paper_id": "p", "source_chunk_ids": []} for i, t in enumerate(["single_hop", "multi_hop", "no_answer", "single_hop", "single_hop"])]
    (tmp_path / "items.jsonl").write_text("".join(json.dumps(i) + "\n" for i in items))
    args = ["--index", f"{tmp_path}/index", "--chunks", f"{tmp_path}/chunks", "--out", f"{tmp_path}/runs", "--model", "json:dumps"]
    run = lambda *a: cli.main(["eval-ragas", *args, *a], spark).first()
    assert run("--items", f"{tmp_path}/items.jsonl").n == 3 and run("--items", f"{tmp_path}/items.jsonl", "--n", "2").n == 2
    (tmp_path / "none.jsonl").write_text(json.dumps(items[1]) + "\n")
    with pytest.raises(ValueError):
        run("--items", f"{tmp_path}/none.jsonl")
