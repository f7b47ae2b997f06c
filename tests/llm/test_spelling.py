"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

from siltstone.llm import spelling

SCHEMA = "doc_id long, text string, word string, r long, n int"


def plain_words(docs):
    counts = Counter()
    for doc, text, *_ in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(docs):
    words = plain_words(docs)
    forms, out = {}, {}
    for w, n in words.items():
        close = sorted((-m, v) for v, m in words.items() if near(w, v))
        forms[w] = close[0][1] if close and -close[0][0] >= 5 * n else None
        out[w] = [n, len(close), forms[w], words.get(forms[w])]
    for w in out:
        root = w
        while forms[root]:
            root = forms[root]
        out[w].append(root)
    return {w: tuple(v) for w, v in out.items()}


def got(spark, docs):
    rows = spelling.variants(spark.createDataFrame(docs, SCHEMA)).collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows}


def some_docs(seed):
    r = random.Random(seed)
    base = ["letter", "lettter", "better", "betters", "aaaaaa", "aaaaaaa", "aaaaab", "straße", "strasse", "Élément", "élément", "motörhead", "abcdefgh", "xletter", "lxetter", "short"]
    mutate = lambda w: (lambda i: r.choice([w[:i] + w[i + 1 :], w[:i] + r.choice("abéß") + w[i:], w[:i] + r.choice("abéßÀ") + w[i + 1 :]]))(r.randrange(len(w)))
    pool = []
    for w in base:
        pool += [w] * r.choice([1, 40, 300])
        for _ in range(6):
            v = mutate(w)
            pool += [v] * r.choice([1, 5, 30])
            pool += [mutate(v)] * r.choice([1, 6])
    say = lambda w: r.choice([w, w, w.upper() if w.isascii() else w, w.capitalize() if w[0].isascii() else w])
    return [(i, r.choice([" ", ", ", "9", "\n", "Ā"]).join(say(r.choice(pool)) for _ in range(r.randint(0, 300))), "x", 1, 2) for i in range(60)]


def test_against_all_pairs(spark):
    docs = some_docs(1)
    docs += [(None, docs[0][1], "x", 1, 2), (7, None, None, None, None), (8, "", "x", 1, 2)] + docs[3:5]
    found = got(spark, docs)
    assert found == plain(docs)
    assert any(v[4] not in (w, v[2]) for w, v in found.items() if v[2]), "a chain of two forms"


def test_a_chain_of_many_forms(spark):
    words = ["aaaaaabbbbbb"[i : i + 6] for i in range(5)]  # neighbours differ by one letter
    docs = [(1, " ".join(w for i, w in enumerate(words) for _ in range(5 ** (i + 1))), "x", 1, 2)]
    found = got(spark, docs)
    assert found == plain(docs) and found[words[0]][4] == words[-1]


def test_one_word_everywhere_and_very_long_words(spark):
    docs = [(i, "everywhere " * 500 + "everywhero " * (i % 3) + "q" * 3000 + " " + "q" * 2999 + "r", "x", 1, 2) for i in range(40)]
    assert got(spark, docs) == plain(docs)


def test_texts_cut_between_runs():
    text = "abcdef " * 700_000 + "x" * 5_000_000
    assert "".join(spelling._pieces(text)) == text and all(not p or p[-1] != "d" for p in spelling._pieces(text))


def test_no_vocabulary_passes_through_the_driver(spark, monkeypatch):
    plans, keep = [], spelling.stored
    monkeypatch.setattr(spelling, "stored", lambda df: plans.append(df._jdf.queryExecution().toString()) or keep(df))
    plans.append(spelling.variants(spark.createDataFrame(some_docs(2), SCHEMA))._jdf.queryExecution().toString())
    assert len(plans) > 3 and sum("SortMergeJoin" in p for p in plans) >= 3 and not any("Broadcast" in p for p in plans)


def test_empty_tables(spark):
    assert got(spark, []) == {} and got(spark, [(1, "few words", "x", 1, 2)]) == {}
