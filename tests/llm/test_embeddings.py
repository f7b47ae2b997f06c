import random

import numpy as np
import pytest

from siltstone.llm import embeddings

SCHEMA = "vec_id long, embedding array<float>, label int, component_id string"


def plain(rows, threshold=0.9):
    ok = {}
    for n, (d, v) in enumerate(rows):
        if d is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            a = np.array(v, np.float32).astype(float)
            ok[n] = a / np.sqrt((a * a).sum())
    linked = {n: [m for m in ok if m != n and len(ok[m]) == len(ok[n]) and float(ok[n] @ ok[m]) >= threshold] for n in ok}
    label = {n: rows[n][0] for n in ok}
    changed = True
    while changed:
        changed = False
        for n in ok:
            for m in linked[n]:
                if label[m] < label[n]:
                    label[n], changed = label[m], True
    return sorted((-1 if d is None else d, len(linked.get(n, ())), -1 if d is None else label.get(n, d), d is not None and label.get(n, d) == d) for n, (d, _) in enumerate(rows))


def corpus(dim=24):
    r = np.random.default_rng(5)
    rows = []
    for _ in range(30):
        c = r.normal(size=dim)
        rows += [c + r.normal(size=dim) * s for s in r.choice([0.05, 0.25, 0.4, 0.6], 8)]
    rows = [[float(np.float32(x)) for x in v] for v in rows]
    rows = list(enumerate(rows)) + [(500 + i, rows[0]) for i in range(40)]
    one = rows[1][1]
    bad = [None, [], [0.0] * dim, [float("nan")] * dim, [float("inf")] + one[1:], [None] + one[1:], one[:5], [x * 7 for x in one]]
    rows += [(600 + i, v) for i, v in enumerate(bad)] + [(None, one), (3, rows[3][1])]
    random.Random(1).shuffle(rows)
    return rows


@pytest.mark.parametrize("part", [2048, 16])
def test_links_and_components_are_those_of_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(embeddings, "PART", part)
    rows = corpus()
    got = embeddings.near_duplicates(spark.createDataFrame([(*x, 1, "clash") for x in rows], SCHEMA)).collect()
    assert sorted((-1 if r[0] is None else r[0], r[1], -1 if r[2] is None else r[2], r[3]) for r in got) == plain(rows)


def test_empty(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_tables_grow_with_the_vectors_and_leave_few_misses():
    for n in (100, 10_000, 1_000_000):
        bits, tables = embeddings.plan_tables(n, 0.9)
        p = (1 - np.arccos(0.9) / np.pi) ** bits
        assert (1 - p) ** tables <= 1e-5
