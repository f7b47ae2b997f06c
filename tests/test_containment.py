"""Passages in texts against a nested loop."""

import random

from siltstone.operators import containment


def test_against_a_nested_loop(spark, monkeypatch):
    monkeypatch.setattr(containment, "BLOCK_CHARS", 60)
    r = random.Random(1)
    texts = [(i, "".join(r.choice("abé ") for _ in range(r.randint(0, 80)))) for i in range(80)] + [(900, None), (901, ""), (None, "abab")]
    passages = [(f"q{i}", "".join(r.choice("abé ") for _ in range(r.randint(1, 6)))) for i in range(60)]
    passages += [("same1", texts[3][1][5:30]), ("same2", texts[3][1][5:30]), ("empty", ""), ("null", None), ("long", "x" * 200), (None, "a")]
    got = containment.containing(spark.createDataFrame(passages, "query_id string, text string"), spark.createDataFrame(texts, "chunk_id int, text string").repartition(3)).collect()
    want = [(q, c) for q, p in passages for c, t in texts if p is not None and t is not None and p in t]
    key = lambda x: (x[0] or "", -1 if x[1] is None else x[1])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_empty_tables(spark):
    p, t = spark.createDataFrame([("q", "a")], "query_id string, text string"), spark.createDataFrame([(1, "a")], "chunk_id int, text string")
    assert containment.containing(p.limit(0), t).collect() == [] and containment.containing(p, t.limit(0)).collect() == []
