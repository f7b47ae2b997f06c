"""The index of cells and codes against brute force, and the exact search in blocks."""

import numpy as np
import pytest

from siltstone.operators import ann, dense
from siltstone.operators.nearest import Best


def clustered(n, dim, seed=4, clusters=25):
    r = np.random.default_rng(seed)
    centers = r.normal(size=(clusters, dim))
    return [(i, [float(x) for x in centers[i % clusters] + 0.6 * r.normal(size=dim)]) for i in range(n)]


def pairs(df):
    return {(x["query_id"], x["chunk_id"]): x["score"] for x in df.collect()}


def brute(rows, asked, k):
    ids, m = [i for i, v in rows], np.array([v for _, v in rows])
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    out = {}
    for q, v in asked:
        s = np.round(m @ (np.array(v) / np.linalg.norm(v)), 6)
        for i in sorted(range(len(ids)), key=lambda i: (-s[i], ids[i]))[:k]:
            out[(q, ids[i])] = s[i]
    return out


@pytest.fixture(scope="module")
def table(spark):
    rows = clustered(1500, 16)
    extra = [(9000, [0.0] * 16), (9001, None), (9002, []), (9003, [1.0] * 5), (9004, [float("nan")] * 16), (None, [1.0] * 16)]
    return rows, spark.createDataFrame(rows + extra, "chunk_id long, vector array<double>").repartition(3)


def test_every_vector_is_indexed_and_most_neighbours_are_found(spark, table, tmp_path):
    rows, frame = table
    index = ann.build(frame, str(tmp_path), sample=800)
    assert sorted(x["chunk_id"] for x in index.members.collect()) == [i for i, _ in rows]
    assert {len(x["code"]) for x in index.members.select("code").collect()} == {16}
    asked = frame.where("chunk_id % 20 = 0 AND chunk_id < 9000").withColumnRenamed("chunk_id", "query_id")
    exact, found = brute(rows, [r for r in rows if r[0] % 20 == 0], 10), pairs(ann.search(index, asked, 10))
    shared = exact.keys() & found.keys()
    assert len(found) == len(exact) and len(shared) >= 0.9 * len(exact) and all(abs(exact[p] - found[p]) < 2e-6 for p in shared)
    all_of_it = pairs(ann.search(index, asked, 10, probes=10_000, refine=2000))
    assert all_of_it.keys() == exact.keys()
    again = ann.load(spark, str(tmp_path))
    assert pairs(ann.search(again, asked, 10)) == found


def test_a_search_reads_the_folders_of_its_cells_alone(spark, table, tmp_path):
    rows, frame = table
    index = ann.build(frame, str(tmp_path), sample=800)
    one = spark.createDataFrame([("q", rows[7][1])], "query_id string, vector array<double>")
    found = ann.search(index, one, 5, probes=2)
    plan = found._jdf.queryExecution().explainString(found._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    filters = [line for line in plan.splitlines() if "PartitionFilters" in line]
    assert filters and all("cell" in f and " IN (" in f and f.count(",") <= 2 for f in filters)
    read = [line for line in plan.splitlines() if line.startswith("ReadSchema")]
    assert any("code" in r and "vector" not in r for r in read) and any("vector" in r and "code" not in r for r in read)
    assert found.orderBy("rank").first()["chunk_id"] == rows[7][0]


def test_a_third_of_all_vectors_in_one_cell(spark, tmp_path):
    rows = clustered(600, 8) + [(10_000 + i, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0]) for i in range(300)]
    index = ann.build(spark.createDataFrame(rows, "chunk_id long, vector array<double>"), str(tmp_path), cells=12)
    assert index.members.count() == 900
    one = spark.createDataFrame([(1, rows[-1][1])], "query_id int, vector array<double>")
    assert [r["chunk_id"] for r in ann.search(index, one, 4).orderBy("rank").collect()] == [10_000, 10_001, 10_002, 10_003]


def test_questions_with_ids_of_two_parts(spark, table, tmp_path):
    rows, frame = table
    index = ann.build(frame, str(tmp_path), sample=300)
    asked = spark.createDataFrame([((7, i), rows[i][1]) for i in range(3)], "query_id struct<a:int,b:int>, vector array<double>")
    assert sorted(tuple(r["query_id"]) for r in ann.search(index, asked, 1).collect()) == [(7, 0), (7, 1), (7, 2)]
    assert dense.search(frame, asked, 2).count() == 6


def test_empty_index_and_no_questions(spark, table, tmp_path):
    _, frame = table
    asked = frame.where("chunk_id < 40").withColumnRenamed("chunk_id", "query_id")
    assert ann.search(ann.build(frame.limit(0), f"{tmp_path}/a"), asked).collect() == []
    index = ann.build(frame, f"{tmp_path}/b", sample=300)
    assert ann.search(index, asked.limit(0)).collect() == [] and ann.search(index, asked.selectExpr("query_id", "array(1D) vector")).collect() == []
    with pytest.raises(ValueError):
        ann.search(index, asked, 0)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_exact_search_in_blocks(spark, table, monkeypatch, kind):
    rows, frame = table
    rows = [(str(i) if kind == "string" else i, v) for i, v in rows]
    frame = frame.selectExpr(f"cast(chunk_id AS {kind}) chunk_id", "vector").where("chunk_id IS NULL OR cast(chunk_id AS long) < 9000 OR cast(chunk_id AS long) > 9000")
    asked = [r for r in rows if int(r[0]) % 50 == 0]
    q = spark.createDataFrame(asked, f"query_id {kind}, vector array<double>")
    want = brute(rows, asked, 7)
    monkeypatch.setattr(dense, "BLOCK", 11)
    monkeypatch.setattr(dense, "CHUNK", 100)
    got = pairs(dense.search(frame, q, 7))
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 2e-6 for p in got)


def test_best_of_a_stream_with_ties():
    r = np.random.default_rng(1)
    for dtype in (np.int64, object):
        for _ in range(100):
            n, k = r.integers(1, 6), r.integers(1, 6)
            best, every = Best(n, k), [[] for _ in range(n)]
            for b in range(r.integers(1, 8)):
                ids = r.permutation(1000)[: r.integers(0, 9)] + 1000 * b
                ids = ids if dtype is np.int64 else np.array([f"x{i}" for i in ids], object)
                asked = np.flatnonzero(r.random(n) < 0.7)
                scores = r.integers(-3, 3, (len(asked), len(ids))) / 2.0
                best.add(asked, scores, ids)
                for i, q in enumerate(asked):
                    every[q] += zip(-scores[i], ids, strict=True)
            got = {q: list(zip((-s).tolist(), ids.tolist(), strict=True)) for q, s, ids in best.rows()}
            assert all(got.get(q, []) == sorted((float(s), i) for s, i in every[q])[:k] for q in range(n))
