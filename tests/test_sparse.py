"""The sharded index and pruned search against scoring every posting."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from siltstone.operators import sparse


def some_chunks(seed, n=400):
    r = random.Random(seed)
    words, weights = [f"w{i}" for i in range(500)] + ["the", "of"], [1 / (i + 2) for i in range(500)] + [3, 2]
    return [(i, "s", " ".join(r.choices(words, weights, k=r.randint(0, 60)))) for i in range(n)]


def plain(chunks, questions, k):
    docs = {c: t.lower().split() for c, _, t in chunks}
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    df = Counter(w for ws in docs.values() for w in set(ws))
    raw = {w: math.log(n - f + 0.5) - math.log(f + 0.5) for w, f in df.items()}
    low = 0.25 * sum(raw.values()) / len(raw)
    out = {}
    for q, text in questions:
        scores = []
        for c, ws in docs.items():
            tf = Counter(ws)
            s = sum((raw[w] if raw[w] >= 0 else low) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(ws) / avg)) for w in text.split() if w in tf)
            if s > 0:
                scores.append((-round(s, 6), c))
        out[q] = [(c, -s) for s, c in sorted(scores)[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["chunk_id"], r["score"]))
    return out


@pytest.mark.parametrize("shard", [300, 5000, 1 << 24])
def test_pruned_search_gives_what_scoring_all_gives(spark, monkeypatch, shard):
    monkeypatch.setattr(sparse, "SHARD", shard)
    monkeypatch.setattr(sparse, "BLOCK", 8)
    chunks = some_chunks(1)
    r = random.Random(2)
    questions = [(q, " ".join(r.choice(["the", "of", *(f"w{int(500 * r.random() ** 2)}" for _ in range(8))]) for _ in range(r.randint(1, 12)))) for q in range(40)]
    index = sparse.build(spark.createDataFrame(chunks, "chunk_id long, section_title string, text string").repartition(3))
    asked = spark.createDataFrame(questions, "query_id int, text string")
    want = plain(chunks, questions, 10)
    got = found(sparse.search(index, asked, 10))
    assert {q: [c for c, _ in v] for q, v in got.items()} == {q: [c for c, _ in v] for q, v in want.items() if v}
    assert all(abs(a[1] - b[1]) < 2e-6 for q in got for a, b in zip(got[q], want[q], strict=True))
    every = sparse.top_k(sparse.score(index, asked).where("score > 0"), 10)
    assert found(every) == got


def test_fewer_postings_are_scored(spark, monkeypatch):
    monkeypatch.setattr(sparse, "SHARD", 20_000)
    chunks = some_chunks(3, 3000)
    index = sparse.build(spark.createDataFrame(chunks, "chunk_id long, section_title string, text string").coalesce(1))
    asked = spark.createDataFrame([(q, f"the of w{q} w{7 * q}") for q in range(20, 40)], "query_id int, text string")
    pruned, every = (spark.sparkContext.accumulator(0) for _ in range(2))
    got = found(sparse.search(index, asked, 3, touched=pruned))
    sparse._scored(index, asked, None, "query_id", "text", 6, every).count()
    assert got == {q: v[:3] for q, v in found(sparse.search(index, asked, 10)).items()}
    assert 0 < pruned.value < 0.5 * every.value


def test_postings_vocabulary_and_totals(spark):
    chunks = some_chunks(5, 60) + [(1000, "s", None), (None, "s", "no id"), (1001, "s", "")]
    index = sparse.build(spark.createDataFrame(chunks, "chunk_id long, section_title string, text string"))
    docs = {c: (t or "").split() for c, _, t in chunks if c is not None}
    assert {(p.chunk_id, p.term): (p.tf, p.dl) for p in index.postings.collect()} == {(c, w): (n, len(ws)) for c, ws in docs.items() for w, n in Counter(ws).items()}
    assert {v.term: v.df for v in index.vocabulary.collect()} == Counter(w for ws in docs.values() for w in set(ws))
    total = index.totals.first()
    assert total.n == len(docs) and total.avgdl == pytest.approx(sum(map(len, docs.values())) / len(docs))


def test_a_search_reads_the_folders_of_its_terms_alone(spark, tmp_path):
    sparse.save(sparse.build(spark.createDataFrame(some_chunks(6), "chunk_id long, section_title string, text string")), str(tmp_path))
    index = sparse.load(spark, str(tmp_path))
    hits = sparse.search(index, spark.createDataFrame([(1, "w3")], "query_id int, text string"), 5)
    plan = hits._jdf.queryExecution().explainString(hits._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    filters = [line for line in plan.splitlines() if "PartitionFilters" in line]
    assert filters and all("folder" in f for f in filters) and hits.count() == 5


def test_empty_and_unknown(spark):
    none = sparse.build(spark.createDataFrame([], "chunk_id string, text string"))
    asked = spark.createDataFrame([(1, "a b"), (2, ""), (3, None)], "query_id int, text string")
    assert sparse.search(none, asked).collect() == [] and none.totals.first().n == 0
    one = sparse.build(spark.createDataFrame([("x", "a a b"), ("y", None), ("z", "c")], "chunk_id string, text string"))
    assert [r.chunk_id for r in sparse.search(one, asked).collect()] == ["x"]
    assert sparse.search(one, asked.limit(0)).collect() == []


def test_bounds_hold_whatever_the_mean_length():
    r = np.random.default_rng(1)
    for _ in range(200):
        tf, dl, avg = r.integers(1, 30, 50), r.integers(1, 500, 50), float(r.uniform(1, 400))
        assert sparse.gain(tf, dl, avg).max() <= sparse.gain(tf.max(), dl.min(), avg) + 1e-12


def test_an_index_in_batches_is_that_of_all_chunks(spark, tmp_path):
    chunks = some_chunks(8, 300)
    frame = lambda rows: spark.createDataFrame(rows, "chunk_id long, section_title string, text string")
    asked = spark.createDataFrame([(q, f"the w{q} w{3 * q} of") for q in range(12)], "query_id int, text string")
    want = found(sparse.search(sparse.build(frame(chunks)), asked, 10))
    path = f"{tmp_path}/i"
    for number, part in enumerate((chunks[:100], chunks[100:110], chunks[110:])):
        sparse.add(frame(part), path, number)
    assert found(sparse.search(sparse.load(spark, path), asked, 10)) == want
    sparse.add(frame(chunks[100:110]), path, 1)  # a batch that is run again
    index = sparse.load(spark, path)
    assert found(sparse.search(index, asked, 10)) == want and index.totals.first().n == 300
    import shutil

    shutil.copytree(f"{path}/blocks/batch=0", f"{path}/blocks/batch=7")  # a batch that broke off before it counted
    shutil.copytree(f"{path}/vocabulary/batch=0", f"{path}/vocabulary/batch=7")
    assert found(sparse.search(sparse.load(spark, path), asked, 10)) == want
    sparse.save(index, f"{tmp_path}/one")
    assert found(sparse.search(sparse.load(spark, f"{tmp_path}/one"), asked, 10)) == want
    shutil.rmtree(f"{path}/totals")  # worked out anew
    assert found(sparse.search(sparse.load(spark, path), asked, 10)) == want


def test_a_stream_of_chunks_is_indexed(spark, tmp_path):
    from siltstone.streaming import ingest

    source = tmp_path / "in"
    chunks = some_chunks(9, 60)
    schema = "chunk_id long, section_title string, text string"
    for part in (chunks[:30], chunks[30:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(source))
        ingest.index_batches(spark.readStream.schema(schema).parquet(str(source)), f"{tmp_path}/i", f"{tmp_path}/c").awaitTermination()
    index = sparse.load(spark, f"{tmp_path}/i")
    asked = spark.createDataFrame([(1, "w1 the"), (2, "w5")], "query_id int, text string")
    assert found(sparse.search(index, asked, 5)) == found(sparse.search(sparse.build(spark.createDataFrame(chunks, schema)), asked, 5))


def test_a_shard_is_built_without_all_its_tokens_at_once():
    import tracemalloc

    r = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    texts = pa.array([" ".join(r.choice(words) for _ in range(r.choice([0, 5, 2000]))) for _ in range(1200)], pa.string())
    tracemalloc.start()
    rows = sparse._shard(3, pa.array(range(len(texts)), pa.int64()), texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    counts = [Counter(t.split()) for t in texts.to_pylist()]
    for row in rows.to_pylist()[:-1]:
        held = [i for i, c in enumerate(counts) if row["term"] in c]
        assert row["ords"] == held and row["tfs"] == [counts[i][row["term"]] for i in held] and row["n"] == len(held)
    assert rows["dls"][-1].as_py() == [sum(c.values()) for c in counts] and peak < 8 * sum(map(len, texts.to_pylist()))
