import random
import zlib

import numpy as np

from siltstone.llm import toxicity

WORDS = "the and of river table green walking paper house seven quietly under window morning bread stone paint".split()
BAD = ["dreckling", "grubhead", "vilento"]


def corpus(n=900, seed=4):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        words = [r.choice(WORDS) + r.choice(["", ".", ","]) for _ in range(r.randint(1, 120))]
        y = int(i % 5 == 0)
        if y:
            for _ in range(r.randint(1, 3)):
                words.insert(r.randrange(len(words) + 1), r.choice(BAD) + r.choice(["", "s", "isch", "."]))
        rows.append((i, " ".join(words), y))
    return rows


def test_held_out_rows_are_told_apart(spark):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, 0.5, "x") for d, t, _ in rows] + [(5000, None, 0.1, "x"), (5001, "", 0.1, "x"), (5002, "word " * 30_000, 0.1, "x"), (0, rows[0][1], 0.2, "y")], "doc_id long, text string, toxicity double, lang string")
    labels = spark.createDataFrame([(d, y, 1) for d, _, y in rows] + [(None, 1, 1), (7, None, 1)], "doc_id long, toxic int, text int")
    got = toxicity.classify(docs, labels)
    assert set(got.columns) == {"doc_id", "text", "toxicity", "lang", "toxicity_lang"}
    found = got.collect()
    assert len(found) == len(rows) + 4 and all(0 <= r["toxicity"] <= 1 for r in found)
    score = {r["doc_id"]: r["toxicity"] for r in found}
    held = [(score[d], y) for d, _, y in rows if zlib.crc32(str(d).encode()) % 3 == 1]
    right = sum((s >= toxicity.CUT) == bool(y) for s, y in held)
    assert right >= 0.97 * len(held)
    assert all(score[d] < toxicity.CUT for d in (5000, 5001, 5002))
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {d for d, s in score.items() if s < toxicity.CUT}


def test_batches_do_not_change_scores():
    rows = corpus(120)
    model = toxicity.train([(t, y) for _, t, y in rows])
    texts = [t for _, t, _ in rows]
    together = toxicity.Embedder(model).texts(texts)[0]
    alone = [toxicity.Embedder(model).texts([t])[0][0] for t in texts]
    assert np.allclose(together, alone)


def test_without_one_label_nothing_is_toxic():
    for rows in ([], [("a b", 0)] * 9, [("a b", 1)] * 9, [(None, 1), ("", 0)]):
        model = toxicity.train(rows)
        logit, lang = toxicity.Embedder(model).texts(["some words", None])
        assert (model.score(logit, lang) < toxicity.CUT).all()


def test_language_guess():
    e = toxicity.Embedder(toxicity.train([]))
    texts = ["the cat and the dog in the house", "der Hund und die Katze sind nicht auf dem Dach", "le chat et la souris dans les bois", "el perro y los gatos en la casa", "xyz"]
    assert [[*toxicity.LANGUAGES, ""][i] for i in e.texts(texts)[1]] == ["en", "de", "fr", "es", ""]


def test_a_language_with_few_toxic_texts_is_not_lost():
    """Spanish has a twentieth of the texts; its toxic words are its own, as those of English are."""
    r = random.Random(8)

    def text(lang, y):
        words = [r.choice(toxicity.FUNCTION_WORDS[lang]) if r.random() < 0.4 else r.choice(WORDS)[:4] + lang + str(r.randint(0, 40)) for _ in range(r.randint(20, 120))]
        bad = {"en": ["grubhead", "dreckling"], "es": ["bomentello", "bomentera", "bomentista"]}[lang]
        return " ".join(words + [r.choice(bad) for _ in range(2 * y)])

    some = lambda n, n_es: [(text(lang, y), y) for lang, k in (("en", n), ("es", n_es)) for i in range(k) for y in [int(i % 6 == 0)]]
    held = some(300, 300)
    for seed in (3, 4, 5):
        model = toxicity.train(some(1200, 90), seed=seed)
        logit, lang = toxicity.Embedder(model).texts([t for t, _ in held])
        got = [(s >= toxicity.CUT, bool(y), k) for s, (_, y), k in zip(model.score(logit, lang), held, lang, strict=True)]
        for k in (0, 3):
            caught = [a for a, y, l in got if y and l == k]
            assert sum(caught) >= 0.9 * len(caught) and sum(a for a, y, l in got if not y and l == k) <= 0.03 * len(caught) * 5


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert toxicity.classify(none, spark.createDataFrame([], "doc_id long, toxic int")).collect() == []


def test_all_labelled_rows_count(spark, monkeypatch):
    """More rows than a part: each is learnt from, whatever its length and label, and reruns agree."""
    monkeypatch.setattr(toxicity, "PART", 200)
    rows = corpus(1500)
    rows += [(i, "stone " * 6000 + "zwerkel", 1) for i in range(2000, 2060)]  # a word in long texts only
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(d, y) for d, _, y in rows], "doc_id long, toxic int")
    usable = [d for d, _, _ in rows if zlib.crc32(str(d).encode()) % 3 != 1]
    taken = toxicity.training_rows(docs, labels)
    assert sorted(r["id"] for r in taken.collect()) == usable
    model = toxicity.fit(taken)
    assert model == toxicity.fit(taken.repartition(7))
    score = {r["doc_id"]: r["toxicity"] for r in toxicity.score_documents(docs, model).collect()}
    held = [(score[d], y) for d, _, y in rows if zlib.crc32(str(d).encode()) % 3 == 1]
    assert sum((s >= toxicity.CUT) == bool(y) for s, y in held) >= 0.97 * len(held)
