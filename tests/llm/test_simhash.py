import random

import numpy as np
import xxhash

from siltstone.llm import simhash
from siltstone.llm.common import connected_components

SCHEMA = "doc_id long, text string, fp string, component_id int"


def plain_fingerprint(text, k=3):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows, radius=3):
    fps = [plain_fingerprint(t) for _, t in rows]
    label = {i: i for i in range(len(rows))}
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if bin(fps[i] ^ fps[j]).count("1") <= radius and label[j] < label[i]:
                    label[i], changed = label[j], True
    out = []
    for i in range(len(rows)):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None]
        out.append((rows[i][0], fps[i], min(ids) if ids else None))
    return out


def corpus():
    r = random.Random(4)
    base = [" ".join(r.choice("abcdefghij") * r.randint(1, 4) for _ in range(r.randint(1, 300))) for _ in range(25)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, base[i % 5] + " end") for i in range(20)] + [(200 + i, base[6]) for i in range(30)]
    return rows + [(300, None), (301, ""), (302, " \n"), (None, base[7]), (303, "Word"), (304, "word"), (305, "É é"), (306, "x " * 20000), (7, base[7])]


def test_fingerprints_and_components_are_those_of_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], SCHEMA)
    got = sorted(tuple(r) for r in simhash.simhash_components(docs).collect() if r[0] is not None)
    want = sorted((d, f - (1 << 64) if f >> 63 else f, c) for d, f, c in plain_components(rows) if d is not None)
    assert got == want


def test_every_pair_within_the_radius_shares_a_table():
    r, tables = random.Random(1), [m & (1 << 64) - 1 for m in simhash.masks(3)]
    assert len(tables) == 15
    for _ in range(3000):
        a = r.getrandbits(64)
        b = a
        for bit in r.sample(range(64), r.randint(0, 3)):
            b ^= 1 << bit
        assert any(a & m == b & m for m in tables)


def test_blocks_of_large_buckets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PART", 7)
    r = random.Random(2)
    fps = {0} | {sum(1 << b for b in r.sample(range(64), 3)) - (1 << 63) * 0 for _ in range(120)}
    fps = [f - (1 << 64) if f >> 63 else f for f in fps]
    found = connected_components(simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"))).collect()
    assert len({c for _, c in found}) == 1 and len(found) == len(fps)


def test_drop_keeps_one_of_each_component_and_all_columns(spark):
    rows = [(1, "a b c d", "x"), (2, "a b c d", "y"), (2, "a b c d", "y"), (3, "completely other words here now", "z"), (None, "a b c d", "n")]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted((r[0] or 0, r[2]) for r in kept) == [(1, "x"), (3, "z")]


def test_drop_tells_rows_with_one_id_apart_and_takes_any_names(spark):
    rows = [(1, "a b c d", "x", "k", 1), (1, "words of another document are here", "y", "l", 2), (1, "a b c d", "x", "k", 1), (None, "quite a third text that has no id", "z", "m", 3)]
    names = ["doc_id", "text", "_keep", "doc", "t"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _keep string, doc string, t int")
    for similarity in (None, 0.8):
        kept = simhash.drop_near_duplicates(docs, similarity=similarity)
        assert kept.columns == names and sorted(r["t"] for r in kept.collect()) == [1, 2, 3]
        assert simhash.drop_near_duplicates(docs.limit(0), similarity=similarity).collect() == []


def test_empty(spark):
    assert simhash.simhash_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components_of_random_graphs(spark):
    r = random.Random(9)
    edges = [(r.randint(0, 150), r.randint(0, 150)) for _ in range(110)] + [(i, i + 1) for i in range(200, 260)] + [(5, 5)]
    label = {x: x for e in edges for x in e}
    for _ in range(300):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "x long, y long")).collect()))
    assert got == {x: c for x, c in label.items() if sum(x in e and e[0] != e[1] for e in edges)}


def test_majority_of_long_texts():
    h = np.array([xxhash.xxh64_intdigest(str(i)) for i in range(70_000)], np.uint64)
    plain = sum(1 << b for b in range(64) if 2 * int(((h >> np.uint64(b)) & np.uint64(1)).sum()) > len(h))
    assert simhash.majority(h) == plain


def test_the_pipelines_stage_drops_all_copies_alike_in_five_words(spark):
    import corpus_pipeline

    r = random.Random(12)
    grams = lambda t: {tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))}
    rows = []
    for g in range(12):
        words = [f"w{r.randrange(3000)}" for _ in range(r.choice([100, 500]))]
        for c in range(6):
            w = list(words)
            for _ in range(c if len(w) > 100 else min(c, 1)):
                w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
            rows.append((10 * g + c, " ".join(w)))
    label = {d: d for d, _ in rows}
    sets, near = [grams(t) for _, t in rows], {d: c for d, _, c in plain_components(rows)}
    for _ in range(6):
        for i, (a, _) in enumerate(rows):
            for j, (b, _) in enumerate(rows):
                if near[a] == near[b] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                    label[a] = label[b] = min(label[a], label[b])
    want = sorted(d for d, c in label.items() if d == c)
    assert len(want) < sum(d == c for d, c in near.items())
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(x["doc_id"] for x in corpus_pipeline.dedup_documents(spark, docs, "").collect()) == want


def test_components_of_few_edges_take_few_jobs(spark):
    r = random.Random(3)
    nodes = r.sample(range(-(1 << 61), 1 << 61), 600)
    chain = list(zip(nodes[:400], nodes[1:400]))
    more = [(nodes[r.randrange(400, 600)], nodes[r.randrange(400, 600)]) for _ in range(120)]
    edges = spark.createDataFrame([*chain, *more, *chain[:9], (nodes[5], nodes[5])], "x long, y long")
    context = spark.sparkContext
    context.setJobGroup("few-edges", "")
    got = sorted(map(tuple, connected_components(edges).collect()))
    jobs = len(context.statusTracker().getJobIdsForGroup("few-edges"))
    context.setJobGroup("other", "")
    assert jobs <= 6
    # the rounds of stars alone, and those until 100 edges are left, say the same
    assert got == sorted(map(tuple, connected_components(edges, few=0).collect())) == sorted(map(tuple, connected_components(edges, few=100).collect()))
    assert {n for n, c in got if c == min(nodes[:400])} == set(nodes[:400])
