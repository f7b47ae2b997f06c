"""Byte-pair chunking against another library's encoder and a plain recursion."""

import random

import pytest
from pyspark.sql import functions as F

from siltstone.operators import chunking, subwords

public_tokenizers = pytest.importorskip("public_tokenizers")
SEPARATORS = ["\n\n", "\n", ". ", " "]


@pytest.fixture(scope="module")
def other():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


@pytest.fixture(scope="module")
def pairs(spark):
    return subwords.BytePairs(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))


def ids(other, text):
    return other.encode(text, add_special_tokens=False).ids


def plain_fixed(other, text, size, overlap):
    tokens = ids(other, text)
    if len(tokens) <= size:
        return [text] if text.strip() else []
    out, at = [], 0
    while True:
        out.append(other.decode(tokens[at : at + size], skip_special_tokens=False))
        if at + size >= len(tokens):
            return out
        at += size - overlap


def plain_split(other, text, size, separators):
    if len(ids(other, text)) <= size:
        return [text]
    for i, s in enumerate(separators):
        if s in text:
            pieces = [p + s for p in text.split(s)]
            pieces[-1] = pieces[-1][: -len(s)]
            return [f for p in pieces if p for f in plain_split(other, p, size, separators[i + 1 :])]
    return plain_fixed(other, text, size, 0) if text.strip() else []


def plain_recursive(other, text, size, overlap):
    chunks, room = [], 0
    for f in plain_split(other, text, size, SEPARATORS):
        n = len(ids(other, f))
        if not chunks or n > room:
            chunks.append("")
            room = size
        chunks[-1] += f
        room -= n
    chunks = [c for c in chunks if c.strip()]
    led = [other.decode(ids(other, c)[-overlap:], skip_special_tokens=False) if overlap else "" for c in chunks]
    return chunks[:1] + [led[i] + c for i, c in enumerate(chunks[1:])]


def some_texts():
    r = random.Random(3)
    words = ["the", "tokenization", "über", "straße", "naïve", "x" * 70, "1234567", "don't", "e.g.", "日本語テキスト", "👩‍🔬", "\t", "a.b"]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    texts = ["\n\n".join(". ".join(say(r.randint(1, 15)) for _ in range(r.randint(1, 5))) for _ in range(r.randint(1, 6))) for _ in range(25)]
    return [*texts, "", "  \n ", "word " * 400, "é" * 500, " " * 300 + "end", "\n\n\n\n" * 40 + "x", "one two", "Z" * 3000, "a. b. c. " * 60, None]


@pytest.mark.parametrize(("size", "overlap"), [(16, 4), (40, 0), (7, 6)])
def test_chunks_equal_a_plain_version(spark, pairs, other, size, overlap):
    texts = some_texts()
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = frame.select("i", pairs.count(F.col("t")).alias("n"), pairs.fixed(F.col("t"), size, overlap).alias("f"), pairs.recursive(F.col("t"), size, overlap).alias("r")).collect()
    for row in rows:
        t = texts[row.i]
        if t is None:
            assert row.n is None and row.f == [] and row.r == []
            continue
        assert row.n == len(ids(other, t))
        assert row.f == (plain_fixed(other, t, size, overlap) if t.strip() else [])
        assert row.r == (plain_recursive(other, t, size, overlap) if t.strip() else [])


def test_every_strategy_by_byte_pairs(spark, pairs, other):
    body = ". ".join(f"Sentence {i} says something of subject {i // 7}" for i in range(60)) + "."
    sections = spark.createDataFrame([("p", 0, "s", body), ("p", 1, "s", "short")], "paper_id string, section_index int, section_title string, text string")
    from siltstone.functions.vectors import hash_bag

    for strategy in chunking.STRATEGIES:
        rows = chunking.chunk_sections(sections, strategy, 64, 8, hash_bag, tokenizer=pairs).collect()
        assert all(r.token_count == len(ids(other, r.text)) for r in rows) and {r.section_index for r in rows} == {0, 1}
        longest = max(r.token_count for r in rows)
        assert 32 < longest <= 64 + 8 + 2
    with pytest.raises(ValueError):
        chunking.chunk_sections(sections, "fixed", 8, 8, tokenizer=pairs)


def test_fragments_lose_nothing(spark, pairs):
    texts = [t for t in some_texts() if t and "Z" * 9 not in t and "é" * 9 not in t and t.strip()]
    frame = spark.createDataFrame([(t,) for t in texts if "日" not in t and " " * 9 not in t], "t string")
    assert frame.where(F.array_join(pairs.fragments(F.col("t"), 20), "") != F.col("t")).count() == 0


@pytest.mark.parametrize("kind", sorted(subwords.PATTERNS))
def test_long_texts_are_not_encoded_and_tails_are_those_of_the_whole_text(kind, monkeypatch):
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        merges = subwords.Merges(f.read(), subwords.PATTERNS[kind])
    r, bits = random.Random(7), ["word", " ", "  ", "\n", "\n\n", ". ", "é", "\u00a0", "\x1c", "!", "'s", "12345", "\u2003x", "Żó", "A", " b", "\t", "漢字", "\r\n"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 120))) for _ in range(400)] + ["the quick brown fox. " * 300]
    for text in texts:
        ends = merges.ends(text)
        for n in (1, 5, 16):
            assert merges.tail(text, n) == text.encode()[ends[-n - 1] if len(ends) > n else 0 :].decode(errors="replace")
            assert not merges.above(text, n) or len(ends) > n
    seen = []
    monkeypatch.setattr(merges, "ids", lambda text, ids=merges.ids: seen.append(len(text)) or ids(text))
    merges.recursive(texts[-1], 32, 4)
    assert max(seen) < 400
