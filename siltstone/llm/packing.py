"""Sequence packing: first-fit decreasing over a tournament tree, in randomised groups of documents.

Documents are dealt to groups by a seeded hash of their id, each group is tokenised and packed in one
task, and no token leaves that task. A document longer than a sequence gives whole sequences first;
what is left of each document is placed, longest first, into the first sequence with room, found in
O(log n) by descending a tournament tree of the sequences' free space. Gaps that remain are filled by
cutting pieces out of the least filled sequences, so that at most one sequence of a group is padded.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_to long"
#: Fixed value: how the byte-level vocabularies of this kind cut a text into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_encoders: dict[str, tiktoken.Encoding] = {}
_added: dict[str, tuple[list[str], Tokenizer]] = {}


def _letters() -> dict[str, int]:
    """The byte that each character of a vocabulary file stands for: printable ones for themselves, the others for the characters from 256 on, in order."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def encoder(path: str) -> tiktoken.Encoding:
    """One encoder for each vocabulary file of the tokenizers library and Python worker.

    The file must hold a byte-level BPE without a normalizer whose merges stand in the order of
    their ids, as a merge is then told by the id of its result. It knows no added tokens: see ``ids_of``.
    """
    if path not in _encoders:
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        before, model = file["pre_tokenizer"] or {}, file["model"]
        special = {t["id"] for t in file["added_tokens"]}
        vocab = {t: i for t, i in model["vocab"].items() if i not in special}
        merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        whole = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        if file["normalizer"] or model["type"] != "BPE" or not whole or merged != sorted(merged):
            raise ValueError("a byte-level BPE vocabulary without a normalizer, its merges in the order of ids, is needed")
        letters = _letters()
        ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items()}
        _encoders[path] = tiktoken.Encoding(path, pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def ids_of(path: str) -> Callable[[str], list[int]]:
    """From a text to the ids that the tokenizers library gives without adding special tokens.

    A text that holds the string of an added token is encoded by the library itself, which cuts texts
    there first.
    """
    if path not in _added:
        with open(path, encoding="utf-8") as f:
            _added[path] = [t["content"] for t in json.load(f)["added_tokens"]], Tokenizer.from_file(path)
    plain, (added, library) = encoder(path).encode_ordinary, _added[path]

    def encode(text: str) -> list[int]:
        if any(a in text for a in added):
            return library.encode(text, add_special_tokens=False).ids
        return plain(text)

    return encode


class FirstFit:
    """Sequences in order of opening; ``place`` finds the first with room by a tournament tree of free space."""

    def __init__(self, capacity: int, most: int) -> None:
        self.capacity, self.leaves, self.opened = capacity, 1, 0
        while self.leaves < most:
            self.leaves *= 2
        self.free = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        free, at = self.free, 1
        while at < self.leaves:
            at *= 2
            if free[at] < size:
                at += 1
        free[at] -= size
        found = at - self.leaves
        self.opened = max(self.opened, found + 1)
        while at > 1:
            at //= 2
            free[at] = max(free[2 * at], free[2 * at + 1])
        return found


def pack(sizes: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length) that cover each document exactly once.

    All sequences are full but one at most. Sizes are at least 1.
    """
    full = [[(d, at, capacity)] for d, n in enumerate(sizes) for at in range(0, n - capacity + 1, capacity)]
    rest = sorted(((n % capacity, d) for d, n in enumerate(sizes) if n % capacity), key=lambda x: (-x[0], x[1]))
    tree, bins = FirstFit(capacity, len(rest)), []
    for n, d in rest:
        at = tree.place(n)
        if at == len(bins):
            bins.append([])
        bins[at].append((d, sizes[d] - n, n))
    room = [capacity - sum(p[2] for p in b) for b in bins]
    order = sorted((i for i in range(len(bins)) if room[i]), key=lambda i: (room[i], i))
    at, giver = 0, len(order) - 1
    while at < giver:
        into, out = order[at], order[giver]
        d, start, n = bins[out].pop()
        take = min(n, room[into])
        bins[into].append((d, start + n - take, take))
        if take < n:
            bins[out].append((d, start, n - take))
        room[into] -= take
        at += not room[into]
        giver -= not bins[out]
        room[out] += take
    return full + [b for b in bins if b]


def pack_documents(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 1, group_chars: int = 6_000_000, seed: int = 11
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_to``.

    ``vocabulary`` is the path of a byte-level BPE file of the tokenizers library, present on every
    executor. Each document's ids end with ``end_id``, so that null, empty and blank texts still give
    one token. Groups hold about ``group_chars`` characters and never less than one whole document;
    their number follows the input, and equal input gives equal sequences. Repeated rows are packed
    each on its own; null ids are packed like others, dealt
    by their text. An empty table gives no rows; columns but the
    two named are not read. padded_to is the sequence's length with its padding: capacity, or the
    sequence's own length where that is a power of two.
    """
    total = docs.agg(F.coalesce(F.sum(F.length(text_col)), F.lit(0)) + F.count("*")).first()[0]
    groups = max(1, -(-total // group_chars))

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = key[0].as_py()
        rows = [(d, t or "") for b in batches for d, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
        rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        encode, ids = ids_of(vocabulary), []
        for i, (d, t) in enumerate(rows):
            ids.append(np.array([*encode(t), end_id], "<u4"))
            rows[i] = (d, None)
        out: list[tuple] = []
        for s, pieces in enumerate(pack([len(x) for x in ids], capacity)):
            offset, length = 0, sum(p[2] for p in pieces)
            padded = length if length & (length - 1) == 0 else capacity
            for d, start, n in pieces:
                crc = zlib.crc32(ids[d][start : start + n])
                out.append((rows[d][0], start, n, crc, len(ids[d]), (group << 32) + s, offset, padded))
                offset += n
        for at in range(0, len(out), 10_000):
            columns = zip(*out[at : at + 10_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[c.split()[0] for c in SCHEMA.split(", ")])

    dealt = docs.select(
        F.pmod(F.xxhash64(F.lit(seed), F.col(id_col).cast("long"), F.when(F.col(id_col).isNull(), F.col(text_col))), F.lit(groups)).alias("group"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    )
    return dealt.groupBy("group").applyInArrow(run, SCHEMA)
