import random
import re

import pytest
from pyspark.sql import functions as F

from siltstone.functions import text, vectors
from siltstone.operators import chunking

PIECE = re.compile(r"\w+|[^\w\s]|\s+")


def plain_split(t, size, separators):
    if len(PIECE.findall(t)) <= size:
        return [t]
    for i, s in enumerate(separators):
        if s in t:
            parts = t.split(s)
            parts = [p + s if k < len(parts) - 1 else p for k, p in enumerate(parts)]
            return [x for p in parts if p for x in plain_split(p, size, separators[i + 1 :])]
    return plain_fixed(t, size, 0)


def plain_fixed(t, size, overlap):
    tokens, out, at = PIECE.findall(t), [], 0
    if not t.strip():
        return []
    if len(tokens) <= size:
        return [t]
    while True:
        out.append("".join(tokens[at : at + size]))
        if at + size >= len(tokens):
            return out
        at += size - overlap


def plain_recursive(t, size, overlap):
    if not t.strip():
        return []
    if len(PIECE.findall(t)) <= size:
        return [t]
    merged, now, n = [], "", 0
    for f in plain_split(t, size, list(chunking.SEPARATORS)):
        k = len(PIECE.findall(f))
        if n + k <= size:
            now, n = now + f, n + k
        else:
            if now:
                merged.append(now)
            now, n = f, k
    if now:
        merged.append(now)
    merged = [m for m in merged if m.strip()]
    return [m if i == 0 or not overlap else "".join(PIECE.findall(merged[i - 1])[-overlap:]) + m for i, m in enumerate(merged)]


def texts():
    r = random.Random(4)
    out = ["", "  \n", "short text.", "word " * 1000, " ".join(f"t{i}" for i in range(500)), "x" * 5000, "\n\n".join(f"Paragraph {i} is short." for i in range(20)), "é.!? " * 90]
    return out + ["".join(r.choice(["word ", "Ab. ", "\n", "\n\n", "q, ", "9", "ö"]) for _ in range(r.randint(1, 400))) for _ in range(40)]


@pytest.mark.parametrize("size,overlap", [(32, 8), (7, 0), (64, 63)])
def test_fixed_and_recursive_are_those_of_plain_walks(spark, size, overlap):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "i int, t string")
    got = rows.select("i", chunking.fixed(F.col("t"), size, overlap).alias("f"), chunking.recursive(F.col("t"), size, overlap).alias("r")).orderBy("i").collect()
    for (i, f, r), t in zip(got, texts()):
        assert f == plain_fixed(t, size, overlap)
        assert r == plain_recursive(t, size, overlap)


def test_bad_sizes_raise():
    for size, overlap in ((0, 0), (5, 5), (5, 6), (5, -1)):
        with pytest.raises(ValueError):
            chunking.fixed(None, size, overlap)


def test_pieces_lose_nothing(spark):
    rows = spark.createDataFrame([(t,) for t in texts()], "t string")
    assert rows.where(F.array_join(text.pieces(F.col("t")), "") != F.col("t")).count() == 0


def sections(spark):
    topic = lambda w: " ".join(f"{w.capitalize()} {w} {w} {w}." for _ in range(6))
    rows = [("p1", 0, "Intro", f"{topic('alpha')} {topic('beta')}"), ("p1", 1, "Method", "One sentence. Two sentences."), ("p2", 0, "Intro", "a b c"), ("p2", 1, "Empty", " ")]
    return spark.createDataFrame(rows, "paper_id string, section_index int, section_title string, text string")


def test_semantic_breaks_between_topics(spark):
    got = {(r["paper_id"], r["section_index"]): r["chunks"] for r in chunking.semantic(sections(spark), vectors.hash_bag, 60, 8).collect()}
    assert got["p1", 1] == ["One sentence. Two sentences."] and got["p2", 0] == ["a b c"] and got["p2", 1] == []
    assert len(got["p1", 0]) == 2 and got["p1", 0][0].count("Beta") == 0 and got["p1", 0][1].startswith("Beta")
    with pytest.raises(ValueError):
        chunking.semantic(sections(spark), None)
    with pytest.raises(ValueError):
        chunking.semantic(sections(spark), vectors.hash_bag, percentile=30)


def test_driver_ids_and_stats(spark):
    s = sections(spark)
    chunks = chunking.chunk_sections(s, "fixed", 16, 4)
    rows = chunks.collect()
    assert len({r["chunk_id"] for r in rows}) == len(rows) and all(r["char_count"] == len(r["text"]) and r["chunk_id"] == f"{r['paper_id']}::{r['section_index']}::{r['chunk_index']}" for r in rows)
    stats = chunking.chunk_stats(s, chunks).first()
    n = sorted(r["token_count"] for r in rows)
    assert (stats["papers"], stats["sections"], stats["chunks"], stats["p90_tokens"], stats["p99_tokens"]) == (2, 4, len(n), n[int(0.9 * (len(n) - 1))], n[int(0.99 * (len(n) - 1))])
    assert stats["median_tokens"] == (n[len(n) // 2] + n[(len(n) - 1) // 2]) / 2 and stats["mean_tokens"] == round(sum(n) / len(n), 1)
    none = chunking.chunk_stats(s, chunks.limit(0)).first()
    assert (none["chunks"], none["mean_tokens"], none["p90_tokens"]) == (0, 0.0, 0)
    assert chunking.chunk_sections(s, "fixed", 100, 0).count() == chunking.chunk_sections(s, "fixed", 100, 64).count()
    with pytest.raises(ValueError):
        chunking.chunk_sections(s, "other")


def test_sentences(spark):
    t = "First one. Second! third? Fourth e.g. this.\n\nNew para. End"
    assert spark.createDataFrame([(t,)], "t string").select(text.sentences(F.col("t"))).first()[0] == ["First one.", "Second! third?", "Fourth e.g. this.", "New para.", "End"]


@pytest.mark.parametrize("strategy", ["fixed", "recursive"])
def test_texts_are_chunked_once(spark, strategy):
    """No filter of the plan works the chunks out a second time, and texts without chunks give no rows."""
    rows = spark.range(4).selectExpr("string(id) paper_id", "0 section_index", "'s' section_title", "element_at(array('', 'a b', null, 'c '), int(id + 1)) text")
    made = chunking.chunk_sections(rows, strategy, 8, 2)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "size(" in line]
    assert sorted((r.paper_id, r.chunk_index, r.text) for r in made.collect()) == [("1", 0, "a b"), ("3", 0, "c ")]
