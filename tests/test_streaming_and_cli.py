import json

import pytest
from pyspark.sql import functions as F

from siltstone import cli
from siltstone.sources import sinks
from siltstone.streaming import ingest


def write(path, name, rows):
    (path / name).write_text("".join(json.dumps(r) + "\n" for r in rows))


def test_each_new_row_is_appended_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    read = lambda: spark.readStream.schema("id string, text string").json(str(source))
    write(source, "1.json", [{"id": "a", "text": "x"}, {"id": "a", "text": "y"}, {"id": "b", "text": "z"}])
    ingest.append_batches(read(), f"{tmp_path}/t", f"{tmp_path}/c").awaitTermination()
    write(source, "2.json", [{"id": "b", "text": "again"}, {"id": "c", "text": "new"}])
    ingest.append_batches(read(), f"{tmp_path}/t", f"{tmp_path}/c").awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/t").collect()) == ["a", "b", "c"]


def test_a_batch_that_broke_off_adds_nothing_twice(spark, tmp_path):
    rows = lambda *ids: spark.createDataFrame([(i, "x") for i in ids], "id string, text string")
    ingest.append_new(rows("a", "b", "b"), f"{tmp_path}/t", 0)
    ingest.append_new(rows("b", "c"), f"{tmp_path}/t", 1)
    import shutil

    shutil.rmtree(f"{tmp_path}/t_ids")  # as if it broke off between the rows and the ids of its first batch
    ingest.append_new(rows("b", "c"), f"{tmp_path}/t", 1)
    known = spark.read.parquet(f"{tmp_path}/t")
    assert sorted(r["id"] for r in known.where("_batch = 1").collect()) in (["b", "c"], ["c"])
    ingest.append_new(rows("c", "d"), f"{tmp_path}/t", 2)
    assert [r["id"] for r in spark.read.parquet(f"{tmp_path}/t").where("_batch = 2").collect()] == ["d"]
    plan = spark.read.parquet(f"{tmp_path}/t_ids").where("_folder IN (1, 2)")._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan


def test_windows_and_chunks_of_streams(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    write(source, "1.json", [{"id": str(i % 4), "ts": f"2024-01-0{1 + i % 3}T10:00:00Z", "k": "ab"[i % 2]} for i in range(12)])
    stream = spark.readStream.schema("id string, ts timestamp, k string").json(str(source))
    q = ingest.arrivals(stream, "ts", "k").writeStream.outputMode("complete").format("memory").queryName("arrivals").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("arrivals").agg(F.sum("n"), F.count("*")).first() == (12, 6)
    q = ingest.new_rows(stream, "id").writeStream.format("memory").queryName("fresh").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("fresh").count() == 4
    sections = tmp_path / "s"
    sections.mkdir()
    write(sections, "1.json", [{"paper_id": "p", "section_index": 0, "section_title": "t", "text": "a b c d e f g h"}])
    s = spark.readStream.schema("paper_id string, section_index int, section_title string, text string").json(str(sections))
    q = ingest.chunk_stream(s, "fixed", 6, 2).writeStream.format("memory").queryName("chunked").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("chunked").count() == 4
    with pytest.raises(ValueError):
        ingest.chunk_stream(s, "semantic")


def test_commands_from_pages_to_evaluation(spark, tmp_path):
    body = "Dense retrieval embeds passages and questions in one space and compares them by angle."
    pages = [(f"p{i}", 1, f"Abstract\n{body} Paper {i}.\n1. Method\nSparse retrieval number{i} scores terms with an inverted index, paper by paper.") for i in range(6)]
    spark.createDataFrame(pages, "paper_id string, page_num int, text string").write.parquet(f"{tmp_path}/pages")
    run = lambda *a: cli.main(list(a), spark).collect()
    assert run("parse", "--pages", f"{tmp_path}/pages", "--out", f"{tmp_path}/sections") == [(6, 0, 12)]
    assert run("chunk", "--sections", f"{tmp_path}/sections", "--out", f"{tmp_path}/chunks")[0]["chunks"] == 12
    assert run("index", "--chunks", f"{tmp_path}/chunks", "--out", f"{tmp_path}/index") == [(12,)]
    where = ["--index", f"{tmp_path}/index", "--chunks", f"{tmp_path}/chunks"]
    assert run("search", *where, "--text", "number4 inverted index", "--k", "3")[0]["chunk_id"] == "p4::1::0"
    write(tmp_path, "items.jsonl", [{"id": "1", "question": "What does number2 do?", "gold_answer": "x", "type": "single_hop", "source_paper_id": "p2", "source_chunk_ids": ["p2::1::0"]}, {"id": "2", "question": "Why?", "gold_answer": "", "type": "no_answer", "source_paper_id": "n/a", "source_chunk_ids": []}])
    for config in ("sparse", "hybrid"):
        (r,) = run("eval-retrieval", *where, "--items", f"{tmp_path}/items.jsonl", "--out", f"{tmp_path}/runs", "--config", config)
        assert (r["n_evaluated"], r["n_no_answer"], r["recall_at_k"]) == (1, 1, 1.0)
    table = (tmp_path / "runs" / "ablation.md").read_text()
    assert table.startswith("# Retrieval ablation") and table.count("\n| sparse |") == 1 and table.count("\n| hybrid |") == 1


def test_commands_with_a_model(spark, tmp_path, monkeypatch):
    """json.dumps stands for a model whose replies hold no JSON object or list."""
    rows = [(f"p{i}::0::0", f"p{i}", "Method", f"Sparse retrieval number{i} scores terms with an inverted index, paper by paper.", "recursive", 120) for i in range(5)]
    spark.createDataFrame(rows, "chunk_id string, paper_id string, section_title string, text string, strategy string, token_count int").write.parquet(f"{tmp_path}/chunks")
    run = lambda *a: cli.main(list(a), spark).collect()
    run("index", "--chunks", f"{tmp_path}/chunks", "--out", f"{tmp_path}/index")
    where = ["--index", f"{tmp_path}/index", "--chunks", f"{tmp_path}/chunks"]
    assert not (tmp_path / "index" / "ann").exists()
    exact = run("search", *where, "--text", "number3 scores", "--config", "dense", "--k", "2")
    monkeypatch.setenv("ANN_MIN_ROWS", "5")  # now a table of five is large
    run("index", "--chunks", f"{tmp_path}/chunks", "--out", f"{tmp_path}/index")
    assert spark.read.parquet(f"{tmp_path}/index/ann/members").count() == 5
    assert run("search", *where, "--text", "number3 scores", "--config", "dense", "--k", "2") == exact
    for config in ("rerank", "multi-query", "hyde"):
        (r,) = run("query", *where, "--text", "Which one is number3?", "--config", config, "--model", "json:dumps")
        assert r["abstained"] and r["answer"] == "(the reply was no valid JSON)" and r["chunk_id"] is None
    with pytest.raises(ValueError):
        run("search", *where, "--text", "number3", "--config", "hyde")
    (made,) = run("generate-evals", "--chunks", f"{tmp_path}/chunks", "--out", f"{tmp_path}/made", "--model", "json:dumps", "--single-hop", "3", "--no-answer", "2")
    assert tuple(made) == (5, 0, 5, 0, 0, 0)
    items = [{"id": str(i), "question": "What does number2 do?", "gold_answer": "x", "type": t, "source_paper_id": "p2", "source_chunk_ids": ["p2::0::0"]} for i, t in enumerate(["single_hop", "no_answer"])]
    write(tmp_path, "items.jsonl", items)
    rest = ["--items", f"{tmp_path}/items.jsonl", "--out", f"{tmp_path}/runs", "--model", "json:dumps"]
    (r,) = run("eval-retrieval", *where, *rest, "--config", "multi-query")
    assert r["recall_at_k"] == 1.0
    (r,) = run("eval-generation", *where, *rest)
    assert (r["config"], r["n"], r["refusal_accuracy"], r["false_grounding_rate"]) == ("rerank", 1, 1.0, 0.0)
    (r,) = run("eval-ragas", *where, *rest)
    assert (r["n"], r["n_abstained"], r["mean_faithfulness"]) == (1, 1, 1.0)
    assert sorted(x.name.split("_")[0] for x in (tmp_path / "runs").iterdir() if x.suffix == ".jsonl") == ["generation", "multi-query", "ragas"]


def test_fetch_is_incremental(spark, tmp_path):
    papers = [{"id": i, "categories": ["cs.LG"], "published": f"2024-0{m}-10T00:00:00Z"} for i, m in (("a", 1), ("b", 2))] + [{"id": "old", "categories": ["cs.LG"], "published": "2020-01-01T00:00:00Z"}, {"id": "off", "categories": ["x"], "published": "2024-01-01T00:00:00Z"}]
    write(tmp_path, "m.jsonl", papers)
    for _ in range(2):
        cli.main(["fetch", "--metadata", f"{tmp_path}/m.jsonl", "--out", f"{tmp_path}/known", "--until", "2024-12-31"], spark)
    assert sorted(r["id"] for r in spark.read.json(f"{tmp_path}/known").collect()) == ["a", "b"]


def test_sinks(spark, tmp_path):
    chunks = spark.createDataFrame([("a", "fixed"), ("b", "recursive")], "chunk_id string, strategy string")
    sinks.write_chunks(chunks, f"{tmp_path}/c")
    sinks.write_chunks(chunks.where("strategy = 'fixed'"), f"{tmp_path}/c")
    assert spark.read.parquet(f"{tmp_path}/c").count() == 2
    assert sinks.write_vectors(chunks.limit(0), f"{tmp_path}/v") == 0 and not (tmp_path / "v").exists()
    assert sinks.run_name("sparse", "fixed", 10, "2024-05-01T10:20:30.5+00:00") == "sparse_fixed_k10_2024-05-01T10-20-30-5+00-00"
