"""A byte-pair tokenizer for the chunkers: counts, windows and recursive splits as columns.

The vocabulary is a file of ranks (a line: the token's bytes in base64, and its number), read by Spark
from any path and sent to the tasks once. Merging is the library's. A text is encoded once for a count
or for windows, which are cut from its bytes by the tokens' offsets and so never encoded back; a window
that begins or ends within a character has the replacement character there. A fragment of recursive
splitting is counted by encoding it alone, as its tokens are not those of the text around it.
With the patterns below no token has parts of two words (runs without ASCII white space), so a text with
more words than a chunk's tokens is split without being encoded, and the last tokens of a chunk are
those of its last words.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.chunking import SEPARATORS, check_sizes

# How texts are cut before merging, for the 50 thousand and the 100 thousand token vocabularies.
PATTERNS = {
    "50k": r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s""",
    "100k": r"""'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}++|\p{N}{1,3}+| ?[^\s\p{L}\p{N}]++[\r\n]*+|\s++$|\s*[\r\n]|\s+(?!\S)|\s""",
}


class Merges:
    """Encoding, and cutting of texts by tokens."""

    def __init__(self, ranks: bytes, pattern: str) -> None:
        import tiktoken

        pairs = (line.split() for line in ranks.splitlines() if line.strip())
        table = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.sizes = np.zeros(max(table.values()) + 1, np.int64)
        self.sizes[list(table.values())] = [len(t) for t in table]
        self.by_word = pattern in PATTERNS.values()

    def ids(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)

    def ends(self, text: str) -> np.ndarray:
        """Where each token of the text ends, in bytes."""
        return np.cumsum(self.sizes[self.ids(text)])

    def count(self, text: str) -> int:
        return len(self.ids(text))

    def windows(self, text: str, size: int, overlap: int) -> list[str]:
        """Windows of ``size`` tokens, each ``size - overlap`` after the last; the first that reaches the end is the last."""
        ends, raw = self.ends(text), text.encode()
        if len(ends) <= size:
            return [text]
        last = -(-(len(ends) - size) // (size - overlap))
        begins = np.arange(last + 1) * (size - overlap)
        at = np.append(0, ends)
        return [raw[at[b] : at[min(b + size, len(ends))]].decode(errors="replace") for b in begins]

    def above(self, text: str, size: int) -> bool:
        """Whether the words alone tell that the text has more than ``size`` tokens."""
        return self.by_word and len(text) > size and len(text.encode().split()) > size

    def tail(self, text: str, n: int) -> str:
        at = text.rfind(" ", 0, max(0, len(text) - 6 * n - 1)) if self.by_word else -1
        while at > 0:
            # a token begins at a space between a character that is no white space and a letter
            if not text[at - 1].isspace() and "A" <= text[at + 1].upper() <= "Z" and len(text[at:].encode().split()) >= n:
                text = text[at:]
                break
            at = text.rfind(" ", 0, at)
        ends = self.ends(text)
        return text.encode()[ends[-n - 1] if len(ends) > n else 0 :].decode(errors="replace")

    def spans(self, text: str, size: int) -> Iterator[tuple[str, int]]:
        """Fragments of at most ``size`` tokens with their counts, in order, cut after the coarsest separators that do."""
        open_spans = [(text, 0)]
        while open_spans:
            part, level = open_spans.pop()
            if not self.above(part, size):
                n = self.count(part)
                if n <= size:
                    yield part, n
                    continue
            level = next((i for i in range(level, len(SEPARATORS)) if SEPARATORS[i] in part), None)
            if level is None:
                yield from ((w, self.count(w)) for w in self.windows(part, size, 0) if part.strip())
                continue
            cuts, at = [0], part.find(SEPARATORS[level])
            while at >= 0:
                cuts.append(at + len(SEPARATORS[level]))
                at = part.find(SEPARATORS[level], cuts[-1])
            cuts.append(len(part))
            open_spans += [(part[a:b], level + 1) for a, b in zip(cuts, cuts[1:], strict=False) if a < b][::-1]

    def recursive(self, text: str, size: int, overlap: int) -> list[str]:
        """Fragments joined while their counts fit; each chunk but the first is led by the last tokens of the one before."""
        merged: list[list[str]] = []
        held = size + 1
        for part, n in self.spans(text, size):
            if held + n > size:
                merged.append([])
                held = 0
            merged[-1].append(part)
            held += n
        chunks = [c for c in map("".join, merged) if c.strip()]
        return [(self.tail(chunks[i - 1], overlap) if i and overlap else "") + c for i, c in enumerate(chunks)]


@lru_cache(maxsize=4)
def _merges(ranks: bytes, pattern: str) -> Merges:
    return Merges(ranks, pattern)


class BytePairs:
    """The tokenizer of one vocabulary, as ``chunking.chunk_sections`` takes it."""

    def __init__(self, spark: SparkSession, path: str, pattern: str = PATTERNS["50k"]) -> None:
        content = spark.read.format("binaryFile").load(path).select("content").first()
        self.ranks: Broadcast[bytes] = spark.sparkContext.broadcast(bytes(content[0]))
        self.pattern = pattern

    def _each(self, use, kind: str):
        ranks, pattern = self.ranks, self.pattern

        def each(texts: pd.Series) -> pd.Series:
            merges = _merges(ranks.value, pattern)
            return pd.Series([use(merges, t) if t is not None else None for t in texts], dtype=object)

        return F.pandas_udf(each, kind)

    def count(self, text: Column) -> Column:
        return self._each(Merges.count, "int")(text)

    def fixed(self, text: Column, size: int = 512, overlap: int = 64) -> Column:
        check_sizes(size, overlap)
        return F.coalesce(self._each(lambda m, t: m.windows(t, size, overlap) if t.strip() else [], "array<string>")(text), F.array().cast("array<string>"))

    def recursive(self, text: Column, size: int = 512, overlap: int = 64) -> Column:
        check_sizes(size, overlap)
        return F.coalesce(self._each(lambda m, t: m.recursive(t, size, overlap) if t.strip() else [], "array<string>")(text), F.array().cast("array<string>"))

    def fragments(self, text: Column, size: int) -> Column:
        """The text in parts of at most ``size`` tokens, as ``recursive`` joins them."""
        return self._each(lambda m, t: [part for part, _ in m.spans(t, size)], "array<string>")(text)
