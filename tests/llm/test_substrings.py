import hashlib
import random

from siltstone.llm import substrings

SCHEMA = "doc_id long, text string, batch int, shard string"


def plain(rows, window=13):
    words = [(t or "").encode().split() for _, t in rows]
    key = [float("inf") if d is None else d for d, _ in rows]
    first = {}
    for w, k in zip(words, key):
        for i in range(len(w) - window + 1):
            g = tuple(w[i : i + window])
            first[g] = min(first.get(g, k), k)
    out = []
    for (d, _), w, k in zip(rows, words, key):
        gone = {j for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] < k for j in range(i, i + window)}
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((-1 if d is None else d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus(seed=3):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["é", "日本"]
    say = lambda n: [r.choice(vocabulary) for _ in range(n)]
    shared = [say(r.randint(8, 40)) for _ in range(12)]
    rows = []
    for d in range(80):
        parts = [say(r.randint(0, 30))]
        for _ in range(r.randint(0, 4)):
            p = r.choice(shared)
            a = r.randint(0, 5)
            parts += [p[a : a + r.randint(5, 40)], say(r.randint(0, 9))]
        rows.append((d, r.choice([" ", "\n", " \t "]).join(w for p in parts for w in p)))
    rows += [(200 + i, rows[3][1]) for i in range(10)] + [(300, None), (301, ""), (302, "one two"), (4, rows[9][1]), (None, rows[5][1]), (400, "the " * 3000), (401, "the " * 50)]
    return rows


def got(frame):
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in frame.collect())


def test_removal_is_that_of_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, 1, "s") for d, t in rows], SCHEMA)
    assert got(substrings.dedup_substrings(docs)) == plain(rows)
    assert got(substrings.dedup_substrings(docs, batch_chars=500, window=9)) == plain(rows, 9)


def test_empty_table(spark):
    assert substrings.dedup_substrings(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_automaton_matching_statistics_and_first_marks():
    r = random.Random(5)
    for _ in range(60):
        docs = [[r.choice("ab") for _ in range(r.randint(1, 14))] for _ in range(5)]
        automaton = substrings.SuffixAutomaton()
        for mark, d in enumerate(docs):
            automaton.add(d, mark)
        text = [r.choice("abc") for _ in range(25)]
        for i, (n, mark) in enumerate(automaton.matches(text, 3)):
            holds = lambda s: [m for m, d in enumerate(docs) if any(d[j : j + len(s)] == s for j in range(len(d)))]
            want = max(k for k in range(i + 2) if k == 0 or holds(text[i + 1 - k : i + 1]))
            assert n == want
            assert mark == (min(holds(text[i - 2 : i + 1])) if n >= 3 else None)


def test_spans_of_a_reference_go(spark):
    ref = spark.createDataFrame([("a b c d e f g h i j k l m n o",), (None,)], "text string")
    docs = spark.createDataFrame([(1, "x a b c d e f g h i j k l m n y"), (2, "a b c d"), (3, None)], "doc_id long, text string")
    assert {r["doc_id"]: (r["n_removed"], r["kept"]) for r in substrings.remove_reference_spans(docs, ref).collect()} == {1: (14, "x y"), 2: (0, "a b c d"), 3: (0, "")}
    nothing = spark.createDataFrame([], "text string")
    assert {r["n_removed"] for r in substrings.remove_reference_spans(docs, nothing).collect()} == {0}
    assert substrings.remove_reference_spans(docs.limit(0), ref).collect() == []
