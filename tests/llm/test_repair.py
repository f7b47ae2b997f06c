"""Conversation repair against whole audits, all edits of short conversations, and conversations that cross blocks."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from siltstone.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, no int, key string"
INITIAL = {"s": repair.S, "u": repair.U, "a": repair.A}


def plain_program(turns):
    """(cost, audit) of (initial, fault) by whole audits."""
    layer = {"": (0, "", "")}  # what stands last -> cost, audit

    def inserted(layer):
        out = {}
        for last, (cost, audit, *_) in layer.items():
            for n in range(4):
                if last not in out or (cost, audit) < out[last][:2]:
                    out[last] = (cost, audit)
                yield last, cost, audit
                last, cost, audit = ("a" if last == "u" else "u"), cost + 3, audit + "I"

    for initial, fault in turns:
        after = {}

        def put(last, cost, audit, after=after):
            if last not in after or (cost, audit) < after[last]:
                after[last] = (cost, audit)

        for last, cost, audit in inserted(layer):
            put(last, cost + 4, audit + "D")
            if fault != repair.MUST_GO:
                extra = 3 if fault == repair.CUT_OFF else 0
                fits = initial == ("a" if last == "u" else "u") or (initial == "s" and last == "")
                if fits:
                    put(initial, cost + extra, audit + "K")
                put("a" if last == "u" else "u", cost + extra + 3, audit + "R")
        layer = after
    return min((cost, audit) for last, cost, audit in inserted(layer) if last in ("", "a"))


def all_edits(turns):
    best = None
    for gaps in itertools.product(range(4), repeat=len(turns) + 1):
        for edits in itertools.product("DKR", repeat=len(turns)):
            said, cost, audit, ok = "", 0, "", True
            for n, e, (initial, fault) in zip(gaps, edits, turns, strict=False):
                for _ in range(n):
                    said += "a" if said[-1:] == "u" else "u"
                audit += "I" * n + e
                cost += 3 * n + (4 if e == "D" else 3 * (e == "R") + 3 * (fault == repair.CUT_OFF))
                ok &= e == "D" or fault != repair.MUST_GO
                said += "" if e == "D" else initial if e == "K" else "a" if said[-1:] == "u" else "u"
            for _ in range(gaps[-1]):
                said += "a" if said[-1:] == "u" else "u"
            audit, cost = audit + "I" * gaps[-1], cost + 3 * gaps[-1]
            if ok and re.fullmatch("(s?(ua)+)?", said) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def solve(turns):
    machine = repair.Machine()
    taken, cost, layer = machine.forward([3 * INITIAL.get(i, 0) + f for i, f in turns], repair.NOTHING)
    extra, _, more, state = repair.ending(layer)
    return cost + extra, "".join(machine.back(taken, state)) + "I" * more


def test_program_against_all_edits_of_short_conversations():
    for n in range(4):
        every = list(itertools.product(itertools.product("suax", range(3)), repeat=n))
        for turns in every if n < 3 else random.Random(1).sample(every, 60):
            assert solve(turns) == all_edits(turns) == plain_program(turns)


def test_program_against_whole_audits():
    r = random.Random(2)
    for _ in range(1500):
        turns = [(r.choice("suuaax"), r.choice([0, 0, 0, 1, 2])) for _ in range(r.randint(0, 40))]
        assert solve(turns) == plain_program(turns)


def test_codes_are_prefix_free_and_few_layers_are_needed():
    assert not any(a != b and b.startswith(a) for a in repair.CODES for b in repair.CODES)
    machine, r = repair.Machine(), random.Random(3)
    for _ in range(3):
        machine.forward([r.randrange(12) for _ in range(20_000)], 0)
    assert len(machine.layers) < 300


def plain(rows):
    """What summaries gives, by a plain walk; ties of one turn as in the docstring are avoided by the tests."""
    out = {}
    for c in {r[0] for r in rows}:
        turns = []
        for _, turn, role, text, *_ in sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0)):
            fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            turns += [(turn, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
        seen, faults, counts = set(), [], [0, 0, 0]
        for _, role, text in turns:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            kind = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else 3
            seen.add((role, text))
            if kind < 3:
                counts[kind] += 1
            faults.append({0: repair.MUST_GO, 1: repair.MUST_GO, 2: repair.CUT_OFF, 3: repair.FINE}[kind])
        known = [t for t, *_ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        cost, audit = plain_program([(role[:1], f) for (_, role, _), f in zip(turns, faults, strict=True)])
        said, i = [], 0
        for e in audit:
            turn = ("", "", "") if e == "I" else turns[i]
            i += e != "I"
            last = said[-1][0][0] if said else ""
            if e != "D":
                said.append((turn[1] if e == "K" else "assistant" if last == "u" else "user", turn[2]))
        text = "\n".join(f"{a}:{b}" for a, b in said)
        out[c] = (gaps, *counts, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def got(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    return {r[0]: tuple(r)[1:] for r in repair.summaries(repair.repair(repair.damage(frame))).collect()}


def some_rows(seed, convs, most):
    r = random.Random(seed)
    texts = ["a.", "b!", "c?", "d", "  ", "", "e. \n", None, ".", "é."]
    roles = ["user", "assistant", "user", "assistant", "system", "sys", "tool", "", None, "under"]
    return [(c, t * r.choice([1, 1, 2]) if t % 2 else 2 * t, r.choice(roles), r.choice(texts) if r.random() < 0.5 else f"say {c} {t}.", 1, "x") for c in convs for t in range(r.randint(1, most))]


def without_ties(rows):
    return list({(r[0], r[1]): r for r in rows}.values())


def test_short_conversations_with_nulls(spark):
    rows = without_ties(some_rows(4, [*range(60), None], 12) + [(5, None, "user", "null turn.", 1, "x"), (77, None, None, None, 1, "x")])
    assert got(spark, rows) == plain(rows)


@pytest.mark.parametrize("batch", ["1", "5"])
def test_conversations_that_cross_blocks(spark, batch):
    rows = without_ties(some_rows(7, range(10), 90) + [(None, t, ("user", "assistant")[t % 2], f"{t % 50}.", 1, "x") for t in range(300)])
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        assert got(spark, rows) == plain(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_repeated_rows_are_duplicates_and_the_order_of_rows_does_not_matter(spark):
    rows = without_ties(some_rows(9, range(8), 10))
    rows += rows[:30]
    shuffled = rows[:]
    random.Random(1).shuffle(shuffled)
    assert got(spark, rows) == got(spark, shuffled) and set(got(spark, rows)) == set(plain(rows))


def test_dropped_conversations_and_an_empty_table(spark):
    gone = next(c for c in range(10_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert got(spark, [(gone, 0, "user", "x.", 1, "x")]) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert got(spark, []) == {}
