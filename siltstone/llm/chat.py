"""Chat formatting: conversations as marked text with a loss mask, put together byte by byte in numpy.

The template (fixed): a user's turn is ``[INST] text [/INST]``, a system's ``[SYS] text [/SYS]``, an
assistant's `` text</s>``, and any other role's ``[ROLE] role [TEXT] text [/TEXT]``; turns follow one
another without anything between. Inside a text or a role, whatever reads like a control string, with
any number of backslashes after its first character, gets one backslash more there, so that no
control string is left, and reading back takes one away. Only an assistant's text is under the loss
mask, neither its marks nor ``</s>``.

Cases: a null text or role is empty; rows of one turn go by role, then text, nulls first, and
repeated rows are turns of their own; null turns come first; rows without conv_id are one
conversation. An empty table gives an empty one. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import in_order, partitions, runs

#: What is escaped: the control strings of the template, and the same with backslashes.
_NAMES = r"/?(?:INST|SYS|ROLE|TEXT|s)[\]>]"
ESCAPED = rf"([\[<])(\\*{_NAMES})"
_UNESCAPE = re.compile(rf"([\[<])\\(\\*{_NAMES})")
#: Before the role (or the text), between role and text, and after the text, by kind.
KINDS = ("user", "system", "assistant")
HEAD = ("[INST] ", "[SYS] ", " ", "[ROLE] ")
MIDDLE = ("", "", "", " [TEXT] ")
TAIL = (" [/INST]", " [/SYS]", "</s>", " [/TEXT]")
ASSISTANT, OTHER = 2, 3
#: Bytes put together by one table of indices; the indices take eight times as many.
SLAB = 1 << 21

BLOCKS = "conv_id {}, part int, no int, whole boolean, n_turns int, formatted string, loss array<struct<start:int,length:int>>"


def _bytes(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an array without nulls, and the offsets of its values in them."""
    large = strings.cast(pa.large_binary())
    offsets = np.frombuffer(large.buffers()[1], np.int64)[large.offset : large.offset + len(large) + 1]
    data = large.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def escape(strings: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(strings.fill_null("").cast(pa.large_string()), ESCAPED, r"\1\\\2")


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


def assemble(roles: pa.Array, texts: pa.Array, starts: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Formatted text and loss mask of each run of rows; ``starts`` has the first row of each, and the number of rows.

    Each row is five segments: head, role, middle, text and tail, each a range of one pool of bytes.
    Their lengths give their places in the output by a cumulative sum, and for slabs of rows one table
    of indices copies the pool's bytes to the preallocated buffer of the output. A row longer than a
    slab is copied segment by segment. Mask: byte ranges of the formatted text.
    """
    names = roles.fill_null("").dictionary_encode()
    kinds = np.array([KINDS.index(r) if r in KINDS else OTHER for r in names.dictionary.to_pylist()], int)[names.indices.to_numpy()] if len(roles) else np.zeros(0, int)
    marks = [m.encode() for m in HEAD + MIDDLE + TAIL]
    mark_len = np.array([len(m) for m in marks]).reshape(3, 4)
    mark_at = (np.cumsum([0] + [len(m) for m in marks])[:-1]).reshape(3, 4)
    role_bytes, role_off = _bytes(escape(names.dictionary))
    text_bytes, text_off = _bytes(escape(texts))
    own = np.frombuffer(b"".join(marks), np.uint8)
    pool = np.concatenate([own, role_bytes, text_bytes])
    roles_from, texts_from = len(own), len(own) + len(role_bytes)

    code, other = names.indices.to_numpy(), kinds == OTHER
    lengths = np.stack([mark_len[0][kinds], np.where(other, np.diff(role_off)[code] if len(code) else 0, 0), mark_len[1][kinds], np.diff(text_off), mark_len[2][kinds]], 1).astype(np.int64)
    sources = np.stack([mark_at[0][kinds], roles_from + role_off[:-1][code], mark_at[1][kinds], texts_from + text_off[:-1], mark_at[2][kinds]], 1).astype(np.int64)
    ends = np.cumsum(lengths.reshape(-1)).reshape(-1, 5)
    places = ends - lengths
    total = int(ends[-1, -1]) if len(ends) else 0
    buffer = pa.allocate_buffer(total)
    out = np.frombuffer(buffer, np.uint8)
    row, row_ends = 0, ends[:, -1]
    while row < len(ends):
        base = int(places[row, 0])
        stop = max(row + 1, int(np.searchsorted(row_ends, base + SLAB, "right")))
        size, source, place = lengths[row:stop].reshape(-1), sources[row:stop].reshape(-1), places[row:stop].reshape(-1)
        upto = int(row_ends[stop - 1])
        if upto - base <= SLAB:
            out[base:upto] = pool[np.repeat(source - place, size) + np.arange(base, upto)]
        else:
            for n, s, p in zip(size, source, place, strict=True):
                out[p : p + n] = pool[s : s + n]
        row = stop
    first = starts[:-1]
    offsets = np.append(places[first, 0], total).astype(np.int32)
    formatted = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), buffer)

    masked = np.flatnonzero(kinds == ASSISTANT)
    block = np.searchsorted(first, masked, "right") - 1
    spans = pa.StructArray.from_arrays([pa.array((places[masked, 3] - offsets[block]).astype(np.int32)), pa.array(lengths[masked, 3].astype(np.int32))], ["start", "length"])
    return formatted, pa.ListArray.from_arrays(pa.array(np.searchsorted(masked, starts).astype(np.int32)), spans)


def format_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Blocks ``conv_id, part, no, whole, n_turns, formatted, loss``; a conversation is its blocks' texts in the order of (part, no).

    A conversation is one block (``whole``) unless it crosses the end of an Arrow batch or of a range
    of rows, so that one of any length is formatted by many tasks, each in the memory of a batch.
    ``loss`` lists the byte ranges of ``formatted`` that count for the loss.
    """
    kind = rows.schema[conv_col].dataType
    named = rows.select(F.col(conv_col).alias("key"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    ordered = in_order(named, ["key", "turn"], ["role", "text"]).drop("turn")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, no = TaskContext.get().partitionId(), 0
        for batch, starts, whole in runs(batches):
            formatted, loss = assemble(batch["role"], batch["text"], starts)
            n = len(whole)
            numbers = pa.array(np.arange(no, no + n, dtype=np.int32))
            sizes = pa.array(np.diff(starts).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch["key"].take(pa.array(starts[:-1])), pa.array(np.full(n, part, np.int32)), numbers, pa.array(whole), sizes, formatted, loss], ["conv_id", "part", "no", "whole", "n_turns", "formatted", "loss"])
            no += n

    return ordered.mapInArrow(blocks, BLOCKS.format(kind.simpleString()))


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """Roles and texts of formatted turns."""
    at = 0
    while at < len(formatted):
        kind = next(k for k in (0, 1, OTHER, ASSISTANT) if formatted.startswith(HEAD[k], at))
        end = formatted.index(TAIL[kind].lstrip(), at)
        stop = end - (len(TAIL[kind]) - len(TAIL[kind].lstrip()))
        body = formatted[at + len(HEAD[kind]) : stop]
        role, _, text = body.partition(MIDDLE[OTHER]) if kind == OTHER else (KINDS[kind], "", body)
        yield unescape(role), unescape(text)
        at = end + len(TAIL[kind].lstrip())


class _Digest:
    """What is read back of one conversation, block by block."""

    def __init__(self) -> None:
        self.turns, self.loss, self.n, self.loss_chars, self.chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0

    def add(self, formatted: str, spans: list[dict]) -> None:
        for role, text in parse(formatted):
            self.n += 1
            self.turns.update(f"{role}\n{text}\n".encode())
        raw = formatted.encode()
        for s in spans:
            text = unescape(raw[s["start"] : s["start"] + s["length"]].decode())
            self.loss.update(text.encode())
            self.loss_chars += len(text)
        self.chars += len(formatted)

    def row(self) -> list:
        return [self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars]


_READ = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]


def read_back(blocks: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars`` of formatted blocks, parsed again.

    Whole conversations are digested where they stand; only the blocks of the others are shuffled and
    digested one after another, in the memory of one batch, as SHA-256 allows no other order.
    """
    kind = blocks.schema["conv_id"].dataType.simpleString()
    done = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    keys, rest = ["conv_id", "part", "no"], ["formatted", "loss"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch["whole"].to_pylist()
            texts, spans, rows = batch["formatted"], batch["loss"], []
            for i, ready in enumerate(whole):
                if ready:
                    digest = _Digest()
                    digest.add(texts[i].as_py(), spans[i].as_py())
                    rows.append(digest.row())
                else:
                    rows.append([None] * 5)
            kept = pa.array([not w for w in whole])
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)] if rows else [pa.array([], t) for t in _TYPES]
            # what is digested is not carried on
            yield pa.RecordBatch.from_arrays([*(batch[k] for k in keys), *columns, *(pc.if_else(kept, batch[c], pa.scalar(None, batch[c].type)) if c == "formatted" else _only(batch[c], kept) for c in rest)], [*keys, *_READ, *rest])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["turns_sha256"] is not None:
                    out.append([r["conv_id"], *(r[c] for c in _READ)])
                    continue
                if digest is None or now != r["conv_id"]:
                    if digest is not None:
                        out.append([now, *digest.row()])
                    now, digest = r["conv_id"], _Digest()
                digest.add(r["formatted"], r["loss"])
            if out:
                yield _rows(out, batch["conv_id"].type)
            last = batch["conv_id"].type
        if digest is not None:
            yield _rows([[now, *digest.row()]], last)

    first = blocks.select(*keys, "whole", *rest).mapInArrow(each, f"conv_id {kind}, part int, no int, {done}, formatted string, loss array<struct<start:int,length:int>>")
    together = first.repartition(partitions(blocks.sparkSession), "conv_id").sortWithinPartitions(*keys)
    return together.mapInArrow(join, f"conv_id {kind}, {done}")


_TYPES = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]


def _only(lists: pa.Array, kept: pa.Array) -> pa.Array:
    return pa.array([v if k else None for v, k in zip(lists.to_pylist(), kept.to_pylist(), strict=True)], lists.type)


def _rows(rows: list[list], key: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [key, *_TYPES], strict=True)], ["conv_id", *_READ])
