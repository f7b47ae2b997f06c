import hashlib
import random

import pytest
from pyspark.sql import functions as F

from siltstone.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, target int"


def plain_targets(sizes, weights=(5, 2, 1), repeats=3):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    stopped, total = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in stopped]
        level = (total - sum(stopped.values())) / sum(w[s] for s in free) if free else 0
        over = [s for s in free if w[s] * level > repeats * sizes[s]]
        if not over:
            return stopped | {s: w[s] * level for s in free}
        stopped |= {s: repeats * sizes[s] for s in over}


def plain(rows):
    size = lambda t: len((t or "").encode().split())
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    targets, queue, out = plain_targets(sizes), [], {}
    for source in sizes:
        own = sorted(((hashlib.md5(f"mix:{d}".encode()).hexdigest(), d, size(t)) for d, t, s in rows if s == source))
        at = 0
        for _, d, n in own:
            out[d] = [n, sizes[source], targets[source], 0]
            for turn in range(3 if targets[source] else 0):
                start = at + turn * sizes[source]
                if n and start <= targets[source]:
                    each = n if start + n <= targets[source] else -(-n // mixing.PACKETS)
                    queue += [((start + min(j + each, n)) / targets[source], source is not None, source or "", turn, j, d, min(each, n - j)) for j in range(0, n, each)]
            at += n
    left = round(sum(targets.values()))
    for *_, d, n in sorted(queue):
        out[d][3] += min(n, left)
        left -= min(n, left)
    return {d: tuple(x) for d, x in out.items()}


def corpus(seed):
    r = random.Random(seed)
    names = ["a", "B", "ä", "z", None, "", "hot"]
    rows = [(i, " ".join("w" for _ in range(r.randint(0, 60))) or None, "hot" if i % 3 == 0 else r.choice(names)) for i in range(300)]
    return rows + [(1000, "x " * 5000, "long"), (1001, "y", "tiny"), (1002, "", "wordless")]


@pytest.mark.parametrize("seed", [1, 2])
def test_shares_are_those_of_the_plain_queue(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame([(*x, "clash", 1) for x in rows], SCHEMA)
    got = {r["doc_id"]: (r["size"], r["source_size"], r["target"], r["taken"]) for r in mixing.mix(docs).collect()}
    want = plain(rows)
    assert set(got) == set(want)
    for d in want:
        assert got[d][:2] == want[d][:2] and got[d][3] == want[d][3] and got[d][2] == pytest.approx(want[d][2])
    assert all(t <= 3 * n for n, _, _, t in got.values())
    for s in {s for _, _, s in rows}:
        mine = [got[d] for d, _, x in rows if x == s]
        assert abs(sum(m[3] for m in mine) - mine[0][2]) <= 6


def test_rows_come_in_order_of_virtual_time(spark):
    times = [r["virtual_finish"] for r in mixing.mix(spark.createDataFrame([(*x, "c", 1) for x in corpus(1)], SCHEMA)).collect() if r["virtual_finish"] is not None]
    assert times == sorted(times)


def test_apply_takes_whole_documents(spark):
    docs = spark.createDataFrame([(i, "a b c d", "s1") for i in range(20)] + [(100 + i, "a b c d", "s2") for i in range(2)] + [(200, None, "s1")], "doc_id long, text string, source string")
    plan = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect()}
    kept = [r["doc_id"] for r in mixing.apply_mix(docs).collect()]
    assert all(kept.count(d) == (1 if d == 200 else n) for d, n in plan.items()) and max(plan.values()) <= 3


def test_empty(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []


def test_apply_deals_copies_out_and_takes_any_names(spark):
    rows = [(1, "a b c", "s1", "x"), (1, "a b c", "s1", "x"), (1, "other words are here", "s1", "y"), (None, "k l m", "s2", "z"), (None, "k l", "s2", "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _id string").withColumn("copies", F.lit(7))
    got = mixing.apply_mix(docs)
    assert got.columns == docs.columns
    plan = mixing.mix(docs).collect()
    assert got.count() == sum(r["copies"] for r in plan)
    assert mixing.apply_mix(docs.limit(0)).collect() == []
