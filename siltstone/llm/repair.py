"""Conversation structure repair by a rank-compressed dynamic program.

The program. Reading a conversation, what is kept must read as role initials ``(s?(ua)+)?``; the state
is what stands last: nothing, s, u or a. For each turn one macro edit is taken: a run of inserted turns
and then keep, rerole or delete. A macro's code is its letters (``I`` for each insertion, then ``K``,
``R`` or ``D``). No code is the beginning of another one, as each ends with its only letter other than
I; so two audits of as many turns compare as their first different codes do, and an audit never has to
be written while searching. Of each state the program keeps the least cost, the *rank* of the best
audit among the audits of that layer, and a pointer (state before, code). The next layer's ranks follow
from sorting (rank, code); the audit is read from the pointers at the end. A run of three insertions
ends in the state of one, so runs of up to two are enough.

A layer depends on the turn only by its initial and fault, and on the costs only by their differences,
which are bounded (see ``FAR``). So layers are the states of a small machine, whose steps are worked
out once and then looked up.

Conversations of any length. Turns are dealt to ranges of (conversation, turn), and cut into blocks. A
conversation within one block is repaired at once. One that crosses blocks is repaired by the same
program in three steps: each block gives the costs and the order of its best edits from each state to
each state; these few numbers are put together along the blocks of a conversation; each block is then
repaired between the states so found. Duplicates across blocks are found by grouping.

Cases: nulls of role, text, and of the key in the hash count as one space; null turns come first; rows
of one turn go by a hash of role and text, repeated rows side by side (all but the first are
duplicates); a role that starts with none of s, u, a can only be reroled or deleted; rows without
conv_id are one conversation; an empty table gives an empty one. Roles and texts are compared by 128
bits of hash. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import in_order, partitions, runs, stored

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3  # costs; to keep costs nothing
NOTHING, S, U, A = range(4)
#: The macro codes in the order of their letters; the place in this list is the code's number.
CODES = sorted("I" * n + last for n in range(3) for last in "DKR")
_AFTER_INSERT = (U, U, A, U)
#: A state that costs more than the best one by this is never needed: from the best state two insertions
#: (6) and one deletion (4) in place of a kept s do whatever the other state can.
FAR = 12
#: Faults of a turn.
FINE, CUT_OFF, MUST_GO = range(3)


def _macros(state: int, initial: int, fault: int) -> Iterator[tuple[int, int, int]]:
    """(number of the code, cost, state after) of what can be done with a turn; ``initial`` is S, U, A or NOTHING for others."""
    cost, inserted = 0, ""
    for _ in range(3):
        yield CODES.index(inserted + "D"), cost + DELETE, state
        if fault != MUST_GO:
            extra = TRUNCATED if fault == CUT_OFF else 0
            to = A if state == U else U
            if initial == to or (initial == S and state == NOTHING):
                yield CODES.index(inserted + "K"), cost + extra, initial
            yield CODES.index(inserted + "R"), cost + extra + REROLE, to
        cost, inserted, state = cost + INSERT, inserted + "I", _AFTER_INSERT[state]


class Machine:
    """Layers as numbered states: a layer is the (state, cost above the least, rank) of the states worth keeping."""

    def __init__(self) -> None:
        self.layers: list[tuple[tuple[int, int, int], ...]] = []
        self.numbers: dict[tuple, int] = {}
        self.steps: dict[int, tuple[int, int, dict[int, tuple[int, int]]]] = {}

    def number(self, layer: tuple) -> int:
        if layer not in self.numbers:
            self.numbers[layer] = len(self.layers)
            self.layers.append(layer)
        return self.numbers[layer]

    def step(self, now: int, symbol: int) -> tuple[int, int, dict[int, tuple[int, int]]]:
        """The next layer, what its least cost adds, and for each of its states (state before, code)."""
        key = now * 12 + symbol
        if key not in self.steps:
            best: dict[int, tuple[int, int, int, int]] = {}
            for state, cost, rank in self.layers[now]:
                for code, more, to in _macros(state, symbol // 3, symbol % 3):
                    found = (cost + more, rank, code, state)
                    if to not in best or found < best[to]:
                        best[to] = found
            least = min(b[0] for b in best.values())
            kept = {to: b for to, b in best.items() if b[0] <= least + FAR}
            order = {to: i for i, to in enumerate(sorted(kept, key=lambda t: kept[t][1:3]))}
            layer = tuple((to, kept[to][0] - least, order[to]) for to in sorted(kept))
            self.steps[key] = self.number(layer), least, {to: (b[3], b[2]) for to, b in kept.items()}
        return self.steps[key]

    def forward(self, symbols: Iterable[int], entry: int) -> tuple[list, int, tuple]:
        """The steps taken from one state, the least cost of the last layer, and that layer."""
        now, cost, taken = self.number(((entry, 0, 0),)), 0, []
        for s in symbols:
            step = self.step(now, s)
            now, cost = step[0], cost + step[1]
            taken.append(step)
        return taken, cost, self.layers[now]

    @staticmethod
    def back(taken: list, state: int) -> list[str]:
        """The codes that led to a state."""
        out = []
        for step in reversed(taken):
            state, code = step[2][state]
            out.append(CODES[code])
        return out[::-1]


def ending(layer: Iterable[tuple[int, int, int]]) -> tuple[int, int, int, int]:
    """Of a last layer: (cost, rank, insertions at the end, state) of the best way to end."""
    return min((cost + INSERT * more, rank, more, state) for state, cost, rank in layer for more in [{NOTHING: 0, S: 2, U: 1, A: 0}[state]])


def _apply(codes: list[str], more: int, state: int, roles: list[str], texts: list[str]) -> tuple[list[str], list[str]]:
    """Roles and texts after the edits, from a state on."""
    out_roles, out_texts = [], []

    def put(role: str, text: str, to: int) -> int:
        out_roles.append(role)
        out_texts.append(text)
        return to

    insert = lambda s: put("assistant" if s == U else "user", "", _AFTER_INSERT[s])
    for code, role, text in zip(codes, roles, texts, strict=True):
        for _ in range(len(code) - 1):
            state = insert(state)
        if code[-1] == "K":
            state = put(role, text, "_sua".index(role[0]))
        elif code[-1] == "R":
            state = put("assistant" if state == U else "user", text, A if state == U else U)
    for _ in range(more):
        state = insert(state)
    return out_roles, out_texts


def damage(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``key, turn, role, text, gone, copy``: the faults of the contract put in by crc32(``conv:turn``) % 20; dropped rows stay, marked ``gone``."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.encode(F.concat(space(conv_col), F.lit(":"), space(turn_col)), "UTF-8")) % 20
    named = rows.select(F.col(conv_col).alias("key"), F.col(turn_col).alias("turn"), space(role_col).alias("role"), space(text_col).alias("text"), fault.alias("fault"))
    return named.select(
        "key", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        (F.col("fault") == 0).alias("gone"), F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )


def _symbols(initials: list[int], bits: list[int], again: list[bool]) -> list[int]:
    """Initial and fault as one number; ``bits`` are blank 1, cut off 2."""
    return [3 * i + (MUST_GO if b & 1 or d else CUT_OFF if b & 2 else FINE) for i, b, d in zip(initials, bits, again, strict=True)]


def _counts(bits: list[int], again: list[bool]) -> tuple[int, int, int]:
    """Turns by their first fault: blank, duplicate, truncated."""
    blank = sum(b & 1 for b in bits)
    twice = sum(d and not b & 1 for b, d in zip(bits, again, strict=True))
    return blank, twice, sum(b == 2 and not d for b, d in zip(bits, again, strict=True))


def _illegal(initials: list[int]) -> int:
    fine = {(S, U), (U, A), (A, U)}
    return sum(pair not in fine for pair in zip(initials, initials[1:], strict=False))


def _gaps(turns: list[int | None], distinct: int) -> int:
    known = [t for t in turns if t is not None]
    return known[-1] - known[0] + 1 - distinct if known else 0


#: What is known of a block. Whole ones are repaired already; of the others the turns are kept as they are.
_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_BLOCK = "conv_id {}, part int, no int, whole boolean, " + _RESULT + ", roles array<string>, texts array<string>, turns array<bigint>, initials array<int>, bits array<int>, h1 array<bigint>, h2 array<bigint>"
_RESULTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
_RAW = ["turns", "initials", "bits", "h1", "h2"]


def _blocks(rows: DataFrame) -> DataFrame:
    """Damaged rows in order as blocks; whole conversations are repaired at once."""
    kind = rows.schema["key"].dataType.simpleString()
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    bits = F.when(bare == "", 1).when(F.right(bare, F.lit(1)).isin(".", "!", "?"), 0).otherwise(2)
    initial = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in (("s", S), ("u", U), ("a", A)) for x in p)), F.left("role", F.lit(1))), F.lit(NOTHING))
    marked = rows.withColumn("h1", F.xxhash64("role", "text")).select("key", F.col("turn").cast("long").alias("turn"), "h1", F.xxhash64(F.lit("turn"), "text", "role").alias("h2"), "copy", "role", "text", "gone", bits.cast("int").alias("bits"), initial.cast("int").alias("initial"))
    ordered = in_order(marked, ["key", "turn", "h1"], ["h2", "copy"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, no, machine = TaskContext.get().partitionId(), 0, Machine()
        for batch, starts, whole in runs(batches):
            here = np.flatnonzero(~batch["gone"].to_numpy(zero_copy_only=False))
            turns, initials, given = batch["turn"].take(pa.array(here)).to_pylist(), batch["initial"].to_numpy()[here].tolist(), batch["bits"].to_numpy()[here].tolist()
            h1, h2 = batch["h1"].to_numpy()[here].tolist(), batch["h2"].to_numpy()[here].tolist()
            roles, texts = batch["role"].take(pa.array(here)).to_pylist(), batch["text"].take(pa.array(here)).to_pylist()
            at, keys, out = np.searchsorted(here, starts), batch["key"], []
            for i, ready in enumerate(whole):
                a, b = at[i], at[i + 1]
                head = [keys[int(starts[i])].as_py(), part, no, bool(ready)]
                no += 1
                if not ready:
                    out.append([*head, *[None] * 7, roles[a:b], texts[a:b], turns[a:b], initials[a:b], given[a:b], h1[a:b], h2[a:b]])
                    continue
                seen: set[tuple[int, int]] = set()
                again = [h in seen or seen.add(h) is not None for h in zip(h1[a:b], h2[a:b], strict=True)]
                taken, cost, layer = machine.forward(_symbols(initials[a:b], given[a:b], again), NOTHING)
                extra, _, more, state = ending(layer)
                codes = machine.back(taken, state)
                known = {t for t in turns[a:b] if t is not None}
                done = _apply(codes, more, NOTHING, roles[a:b], texts[a:b])
                out.append([*head, _gaps(turns[a:b], len(known)), *_counts(given[a:b], again), _illegal(initials[a:b]), cost + extra, "".join(codes) + "I" * more, *done, *[None] * 5])
            yield _batch(out, [keys.type, *_BLOCK_TYPES], ["conv_id", "part", "no", "whole", *_RESULTS, "roles", "texts", *_RAW])

    return ordered.mapInArrow(blocks, _BLOCK.format(kind))


_BLOCK_TYPES = [pa.int32(), pa.int32(), pa.bool_(), *[pa.int64()] * 6, pa.string(), *[pa.list_(pa.string())] * 2, pa.list_(pa.int64()), *[pa.list_(pa.int32())] * 2, *[pa.list_(pa.int64())] * 2]


def _batch(rows: list[list], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def _summaries(pieces: DataFrame) -> DataFrame:
    """Of each block of a longer conversation: from each state the cost and the audit's place for each state after; and what its ends are."""
    kind = pieces.schema["conv_id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Machine()
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                again = _again(r)
                symbols, ways = _symbols(r["initials"], r["bits"], again), []
                for entry in range(4):
                    _, cost, layer = machine.forward(symbols, entry)
                    ways += [x for state, more, rank in layer for x in (entry, state, cost + more, rank)]
                known = [t for t in r["turns"] if t is not None]
                ends = [known[0], known[-1], len(set(known))] if known else [None, None, 0]
                edge = [r["initials"][0], r["initials"][-1]] if r["initials"] else [None, None]
                out.append([r["conv_id"], r["part"], r["no"], ways, *ends, *edge, _illegal(r["initials"])])
            if out:
                yield _batch(out, [batch["conv_id"].type, pa.int32(), pa.int32(), pa.list_(pa.int64()), *[pa.int64()] * 3, pa.int32(), pa.int32(), pa.int64()], ["conv_id", "part", "no", "ways", "first_turn", "last_turn", "n_turns", "first", "last", "illegal"])

    return pieces.mapInArrow(each, f"conv_id {kind}, part int, no int, ways array<bigint>, first_turn long, last_turn long, n_turns long, first int, last int, illegal long")


def _again(r: dict) -> list[bool]:
    twice = set(r["twice"] or [])
    return [i in twice for i in range(len(r["initials"]))]


def _put_together(summaries: DataFrame) -> DataFrame:
    """For each block the state before and after it and the insertions at its end; the first one also has what holds for the conversation."""
    kind = summaries.schema["conv_id"].dataType.simpleString()

    def solve(blocks: list[dict]) -> list[list]:
        now, pointers = [(NOTHING, 0, 0)], []
        gaps_first = last_turn = last = None
        distinct = illegal = 0
        for b in blocks:
            best: dict[int, tuple[int, int, int, int]] = {}
            ways = [b["ways"][i : i + 4] for i in range(0, len(b["ways"]), 4)]
            for state, cost, rank in now:
                for entry, to, more, place in ways:
                    if entry == state and (to not in best or (cost + more, rank, place) < best[to][:3]):
                        best[to] = (cost + more, rank, place, state)
            order = {to: i for i, to in enumerate(sorted(best, key=lambda t: best[t][1:3]))}
            now = [(to, best[to][0], order[to]) for to in best]
            pointers.append({to: v[3] for to, v in best.items()})
            if b["first_turn"] is not None:
                distinct += b["n_turns"] - (b["first_turn"] == last_turn)
                gaps_first = b["first_turn"] if gaps_first is None else gaps_first
                last_turn = b["last_turn"]
            if b["first"] is not None:
                illegal += b["illegal"] + (last is not None and (last, b["first"]) not in {(S, U), (U, A), (A, U)})
                last = b["last"]
        cost, _, more, state = ending(now)
        gaps = last_turn - gaps_first + 1 - distinct if gaps_first is not None else 0
        out = []
        for i in range(len(blocks) - 1, -1, -1):
            before = pointers[i][state]
            out.append([blocks[i]["conv_id"], blocks[i]["part"], blocks[i]["no"], before, state, more if i == len(blocks) - 1 else 0, *([gaps, illegal, cost] if i == 0 else [0, 0, 0])])
            state = before
        return out

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        types = None
        names = ["conv_id", "part", "no", "entry", "exit", "more", "gaps", "illegal", "cost"]
        for batch in batches:
            types = [batch["conv_id"].type, *[pa.int32()] * 5, *[pa.int64()] * 3]
            for r in batch.to_pylist():
                if held and held[0]["conv_id"] != r["conv_id"]:
                    yield _batch(solve(held), types, names)
                    held = []
                held.append(r)
        if held:
            yield _batch(solve(held), types, names)

    ordered = summaries.repartition(partitions(summaries.sparkSession), "conv_id").sortWithinPartitions("conv_id", "part", "no")
    return ordered.mapInArrow(each, f"conv_id {kind}, part int, no int, entry int, exit int, more int, gaps long, illegal long, cost long")


def _repair_pieces(pieces: DataFrame) -> DataFrame:
    """Blocks of longer conversations repaired between their states, in the form of the whole ones."""
    kind = pieces.schema["conv_id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Machine()
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                again = _again(r)
                taken, _, _ = machine.forward(_symbols(r["initials"], r["bits"], again), r["entry"])
                codes = machine.back(taken, r["exit"])
                done = _apply(codes, r["more"], r["entry"], r["roles"], r["texts"])
                out.append([r["conv_id"], r["part"], r["no"], False, r["gaps"], *_counts(r["bits"], again), r["illegal"], r["cost"], "".join(codes) + "I" * r["more"], *done])
            if out:
                yield _batch(out, [batch["conv_id"].type, *_BLOCK_TYPES[:12]], [*["conv_id", "part", "no", "whole"], *_RESULTS, "roles", "texts"])

    return pieces.mapInArrow(each, f"conv_id {kind}, part int, no int, whole boolean, {_RESULT}, roles array<string>, texts array<string>")


def repair(damaged: DataFrame) -> DataFrame:
    """Blocks ``conv_id, part, no, whole, gaps, blank, duplicate, truncated, illegal, cost, audit, roles, texts``.

    ``damaged`` has the columns of ``damage``. A repaired conversation is the turns (``roles`` and
    ``texts``) of its blocks in the order of (part, no); the numbers of its blocks add up, and so do
    the pieces of the audit. ``whole`` conversations are one block.
    """
    first = stored(_blocks(damaged))
    names = ["conv_id", "part", "no", "whole", *_RESULTS, "roles", "texts"]
    place = ["conv_id", "part", "no"]
    pieces = first.where("NOT whole").select(*place, "roles", "texts", *_RAW)
    each = pieces.select(*place, F.posexplode(F.arrays_zip("h1", "h2")).alias("i", "h")).select(*place, "i", F.col("h.h1").alias("h1"), F.col("h.h2").alias("h2"))
    at = F.struct("part", "no", "i")
    firsts = each.groupBy("conv_id", "h1", "h2").agg(F.min(at).alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("conv_id").alias("c"), F.col("h1").alias("a"), F.col("h2").alias("b"), "first")
    later = each.join(firsts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("h1") == F.col("a")) & (F.col("h2") == F.col("b"))).where(at != F.col("first"))
    twice = later.groupBy("part", "no").agg(F.collect_list("i").alias("twice"))
    known = pieces.join(twice, ["part", "no"], "left")
    states = stored(_put_together(_summaries(known.select(*place, *_RAW, "twice"))).drop("conv_id"))
    return first.where("whole").select(*names).unionByName(_repair_pieces(known.join(states, ["part", "no"])).select(*names))


def summaries(repaired: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` of the blocks of ``repair``.

    Whole conversations are digested by expressions; the blocks of the others are read one after another, as SHA-256 must.
    """
    kind = repaired.schema["conv_id"].dataType.simpleString()
    lines = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t)), "\n")
    whole = repaired.where("whole").select("conv_id", *_RESULTS, F.sha2(lines, 256).alias("repaired_sha256"))
    rest = repaired.where("NOT whole").select("conv_id", "part", "no", *_RESULTS, F.size("roles").alias("n"), lines.alias("lines"))
    names = ["conv_id", *_RESULTS, "repaired_sha256"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, types = None, None

        def row(state: list) -> list:
            return [state[0], *state[1], "".join(state[2]), state[3].hexdigest()]

        for batch in batches:
            types, out = [batch["conv_id"].type, *[pa.int64()] * 6, pa.string(), pa.string()], []
            for r in batch.to_pylist():
                if now is None or now[0] != r["conv_id"]:
                    if now is not None:
                        out.append(row(now))
                    now = [r["conv_id"], [0] * 6, [], hashlib.sha256(), False]
                now[1] = [x + r[c] for x, c in zip(now[1], _RESULTS, strict=False)]
                now[2].append(r["audit"])
                if r["n"]:
                    now[3].update((b"\n" if now[4] else b"") + r["lines"].encode())
                    now[4] = True
            if out:
                yield _batch(out, types, names)
        if now is not None:
            yield _batch([row(now)], types, names)

    ordered = rest.repartition(partitions(repaired.sparkSession), "conv_id").sortWithinPartitions("conv_id", "part", "no")
    return whole.unionByName(ordered.mapInArrow(each, f"conv_id {kind}, {_RESULT}, repaired_sha256 string"))
