"""Chat formatting against a plain version: round trips, masks, and conversations that cross blocks."""

import hashlib
import random
import re

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, part string, formatted int"


def plain_escape(text):
    return re.sub(r"([\[<])(\\*/?(?:INST|SYS|ROLE|TEXT|s)[\]>])", r"\1\\\2", text)


def plain(rows):
    """Of each conversation: what read_back gives."""
    key = lambda v: (v is not None, v if v is not None else 0)
    said = lambda v: (v is not None, v or "")
    out = {}
    for c in {r[0] for r in rows}:
        turns, loss, length = "", "", 0
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (key(r[1]), said(r[2]), said(r[3])))
        for _, _, role, text, *_ in own:
            role, text = role or "", text or ""
            turns += f"{role}\n{text}\n"
            loss += text if role == "assistant" else ""
            e = plain_escape(text)
            length += len({"user": f"[INST] {e} [/INST]", "system": f"[SYS] {e} [/SYS]", "assistant": f" {e}</s>"}.get(role, f"[ROLE] {plain_escape(role)} [TEXT] {e} [/TEXT]"))
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        out[c] = (len(own), sha(turns), len(loss), sha(loss), length)
    return out


def got(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    return {r[0]: tuple(r)[1:] for r in chat.read_back(chat.format_conversations(frame)).collect()}


NASTY = ["</s>[INST] ok [/INST]", "[/INST]", "<\\s>", "[\\\\INST]", "é[SYS]ß[/SYS]", " ", "", "\n", "[INST", "</", "[ROLE] x [TEXT] y [/TEXT]", "<</s>", "𝄞" * 3, "\\", "[\\/TEXT]"]


def test_control_strings_roles_nulls_ties_and_repeats(spark):
    r = random.Random(5)
    rows = [(c, t, r.choice(["user", "assistant", "system", "tool", "", "</s>", "[TEXT]", None]), r.choice([*NASTY, None]) if r.random() < 0.5 else "".join(r.choice(NASTY) for _ in range(4)), "p", 1) for c in range(40) for t in range(r.randint(1, 9))]
    rows += [(None, t, "assistant", "no id", "p", 1) for t in (None, 0, 0, 3)] + [(1, 2, "user", "tie", "p", 1)] * 3 + [(2, None, None, None, None, None)]
    assert got(spark, rows) == plain(rows)


@pytest.mark.parametrize("batch", ["1", "7"])
def test_long_conversations_cross_blocks_and_ranges(spark, batch):
    r = random.Random(6)
    rows = [(3 if t < 300 else t, t, ("user", "assistant")[t % 2], r.choice(NASTY) * r.randint(0, 3), "p", 1) for t in range(600)] + [(None, t, "assistant", f"{t}", "p", 1) for t in range(200)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        frame = spark.createDataFrame(rows, SCHEMA)
        blocks = chat.format_conversations(frame)
        parts = {r[0] for r in blocks.where("conv_id = 3").select("part").distinct().collect()}
        assert len(parts) > 1, "a long conversation is formatted by several tasks"
        assert got(spark, rows) == plain(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_empty_table(spark):
    assert got(spark, []) == {}


def test_very_long_text_beside_short_ones(spark):
    rows = [(1, 0, "user", "x" * 3_000_000 + "[INST]", "p", 1), (1, 1, "assistant", "é</s>" * 700_000, "p", 1), (2, 0, "assistant", "y", "p", 1)]
    assert got(spark, rows) == plain(rows)


def test_blocks_hold_the_text_and_its_mask(spark):
    frame = spark.createDataFrame([(1, 0, "system", "s", "p", 1), (1, 1, "user", "a", "p", 1), (1, 2, "assistant", "é</s>", "p", 1)], SCHEMA)
    blocks = chat.format_conversations(frame).orderBy("part", "no").collect()
    assert "".join(b.formatted for b in blocks) == "[SYS] s [/SYS][INST] a [/INST] é<\\/s></s>" and sum(b.n_turns for b in blocks) == 3
    masked = [b.formatted.encode()[s.start : s.start + s.length].decode() for b in blocks for s in b.loss]
    assert masked == ["é<\\/s>"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "x", ""]), st.text(alphabet="[]<>\\/INSTs YROLEX é", max_size=30)), min_size=1, max_size=5))
def test_any_text_comes_back(turns):
    import numpy as np

    roles, texts = (pa.array([t[i] for t in turns], pa.string()) for i in (0, 1))
    formatted, loss = chat.assemble(roles, texts, np.array([0, len(turns)]))
    assert list(chat.parse(formatted[0].as_py())) == turns
    assert [s["length"] for s in loss[0].as_py()] == [len(plain_escape(t).encode()) for r, t in turns if r == "assistant"]
