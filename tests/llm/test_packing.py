import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from siltstone.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_every_token_lies_in_one_piece_and_sequences_have_no_gaps(spark, tokenizer):
    r = random.Random(3)
    texts = {d: " ".join(r.choice(["alpha", "beta.", "gamma,", "é", "12", "x\ny"]) for _ in range(r.choice([0, 1, 5, 200, 3000]))) for d in range(70)} | {100: None, 101: "", 102: "  two  spaces ", 103: "<|endoftext|>", 104: "a <|endoftext|> b", 105: "é<|endoftext|><|endoftext|>x  <|endoftext", 106: "  <|endoftext|>" * 3000}
    docs = spark.createDataFrame([(d, t, 5) for d, t in texts.items()], "doc_id long, text string, offset int")
    rows = packing.pack_documents(docs, PATH, group_chars=40_000).collect()
    ids = {d: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for d, t in texts.items()}
    by_doc, by_sequence = {}, {}
    for x in rows:
        by_doc.setdefault(x["doc_id"], []).append(x)
        by_sequence.setdefault(x["sequence_id"], []).append(x)
    assert set(by_doc) == set(texts)
    for d, pieces in by_doc.items():
        at = 0
        for x in sorted(pieces, key=lambda x: x["start"]):
            assert x["start"] == at and x["doc_tokens"] == len(ids[d])
            assert x["ids_crc32"] == zlib.crc32(ids[d][at : at + x["length"]].tobytes())
            at += x["length"]
        assert at == len(ids[d])
    for pieces in by_sequence.values():
        at = 0
        for x in sorted(pieces, key=lambda x: x["offset"]):
            assert x["offset"] == at
            at += x["length"]
        assert at <= 2048
    padding = sum(p[0]["padded_to"] - sum(x["length"] for x in p) for p in by_sequence.values())
    assert padding <= 2048 * len({s >> 32 for s in by_sequence})
    again = packing.pack_documents(docs.repartition(3), PATH, group_chars=40_000).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_empty_and_repeated_rows(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
    twice = packing.pack_documents(spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string"), PATH).collect()
    assert sorted((x["doc_id"] or 0, x["length"]) for x in twice) == [(0, 2), (1, 3), (1, 3)]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab .,'s\n\t 1é日  ªʰ²<|>"), max_size=40))
def test_ids_are_the_tokenizers(tokenizer, text):
    assert packing.ids_of(PATH)(text) == tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 70), max_size=60))
def test_pack_covers_each_document_once(sizes):
    packed = packing.pack(sizes, 16)
    got = sorted((d, s + i) for b in packed for d, s, n in b for i in range(n))
    assert got == [(d, i) for d, n in enumerate(sizes) for i in range(n)]
    assert sum(sum(n for _, _, n in b) < 16 for b in packed) <= 1


def test_first_fit_is_the_first_with_room():
    r = random.Random(6)
    tree, free = packing.FirstFit(50, 64), [50] * 64
    for _ in range(64):
        n = r.randint(1, 50)
        want = next(i for i, f in enumerate(free) if f >= n)
        free[want] -= n
        assert tree.place(n) == want


def test_other_vocabularies_are_refused(tmp_path):
    import json

    file = json.load(open(PATH, encoding="utf-8"))
    file["model"]["merges"][:2] = file["model"]["merges"][1::-1]
    (tmp_path / "v.json").write_text(json.dumps(file))
    with pytest.raises(ValueError):
        packing.encoder(str(tmp_path / "v.json"))


def test_ids_of_every_kind_of_character_are_the_tokenizers(tokenizer):
    for at in range(0, 0xD800, 64):
        text = " ".join(f"a{chr(c)} {chr(c)}b{chr(c)}{chr(c)}1 {chr(c)}1" for c in range(at, at + 64))
        assert packing.ids_of(PATH)(text) == tokenizer.encode(text, add_special_tokens=False).ids
    for text in (" " * 50_000 + "x", "a" * 50_000, "!?" * 20_000, "x \n" * 20_000):
        assert packing.ids_of(PATH)(text) == tokenizer.encode(text, add_special_tokens=False).ids
