"""Substring dedup: matching statistics against suffix automata of reference shards.

Two forms share the automaton. ``remove_reference_spans`` takes an explicit reference of bounded
size, builds one automaton per shard, broadcasts them and streams the documents. ``dedup_substrings``
takes the corpus as its own reference. Broadcasting it would cost shards times documents, so the
reference is cut into shards by anchors instead and only passages that can match are sent to them:

1. Each window of ``window`` words picks one of its 6-word runs, the one with the least hash. Equal
   windows pick equal runs, so only runs that occur in two documents can lead to a match.
2. For these, the windows that picked the run form a passage, which goes to the run's shard.
3. A shard builds the suffix automaton of its passages, oldest document first, so that each state
   knows the first document that holds its substring, and streams every passage through it: where the
   matching statistic reaches the window, the state gives the first document.
4. Each document drops the words of the windows whose first document is older.

Documents are dealt to batches by a hash of the id and stay with their batch, and each batch sends a
run or a passage once however many of its documents hold it, so a passage that a third of all
documents share costs a shard one row per batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import partitions, words_of

RUN = 6
LAST = np.iinfo(np.int64).max
OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"
MAIL = "shard long, batch long, a binary, b binary, c binary, d binary"


class SuffixAutomaton:
    """Suffix automaton of several word sequences; ``first`` of a state is the mark of the first sequence that holds its substrings, if sequences are added by rising mark."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.first = [-1], [0], [None]

    def _state(self, nxt: dict, link: int, length: int, first: object) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.length.append(length)
        self.first.append(first)
        return len(self.length) - 1

    def _split(self, p: int, word: object, q: int) -> int:
        """The state of p's longest substring with the word appended, taken out of q."""
        if self.length[q] == self.length[p] + 1:
            return q
        new = self._state(self.next[q].copy(), self.link[q], self.length[p] + 1, self.first[q])
        self.link[q] = new
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = new
            p = self.link[p]
        return new

    def add(self, words: list, mark: object) -> None:
        at = 0
        for word in words:
            q = self.next[at].get(word)
            if q is not None:
                at = self._split(at, word, q)
                continue
            new, p = self._state({}, 0, self.length[at] + 1, mark), at
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = new
                p = self.link[p]
            if p >= 0:
                self.link[new] = self._split(p, word, self.next[p][word])
            at = new

    def matches(self, words: list, window: int) -> Iterator[tuple[int, object]]:
        """Matching statistics: for each word, how many words up to it occur in the sequences, and, from ``window`` words on, the mark of the first sequence that holds the last ``window`` of them."""
        at = n = 0
        nxt, link, length, first = self.next, self.link, self.length, self.first
        for word in words:
            while at and word not in nxt[at]:
                at = link[at]
                n = length[at]
            if word in nxt[at]:
                at = nxt[at][word]
                n += 1
            if n < window:
                yield n, None
                continue
            s = at
            while length[link[s]] >= window:
                s = link[s]
            yield n, first[s]


def window_marks(passages: dict[bytes, int], window: int) -> dict[bytes, list[int]]:
    """For each passage (words joined by one space), the least mark of the passages that hold each of its windows."""
    if len(passages) == 1:
        (only, mark), *_ = passages.items()
        return {only: [mark] * (only.count(b" ") + 2 - window)}
    automaton = SuffixAutomaton()
    split = {p: p.split(b" ") for p in passages}
    for p, mark in sorted(passages.items(), key=lambda x: (x[1], x[0])):
        automaton.add(split[p], mark)
    return {p: [m for _, m in automaton.matches(split[p], window)][window - 1 :] for p in passages}


class _Batch:
    """The documents of a batch as one run of words, in an order that any pass finds again."""

    def __init__(self, table: pa.Table) -> None:
        rows = sorted(zip(table["doc_id"].to_pylist(), table["text"].to_pylist(), strict=True), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
        self.ids = [r[0] for r in rows]
        self.marks = np.array([LAST if d is None else d for d in self.ids], np.int64)
        self.words: list[bytes] = []
        ends = []
        for _, text in rows:
            self.words += words_of(text)
            ends.append(len(self.words))
        self.ends = np.array(ends, np.int64)
        self.starts = np.append(0, self.ends[:-1])

    def anchors(self, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each chosen run: its hash, its document, and the first and last window that chose it."""
        none = (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
        n = len(self.words)
        if n < window:
            return none
        v = np.fromiter(map(xxhash.xxh64_intdigest, self.words), np.uint64, n)
        g, runs = np.zeros(n - RUN + 1, np.uint64), window - RUN + 1
        for i in range(RUN):
            g = g * np.uint64(0x9E3779B97F4A7C15) + v[i : n - RUN + 1 + i]
        g ^= g >> np.uint64(29)
        g *= np.uint64(0xBF58476D1CE4E5B9)
        g ^= g >> np.uint64(32)
        m = n - window + 1
        low = g[:m].copy()
        for j in range(1, runs):
            np.minimum(low, g[j : m + j], out=low)
        at = np.zeros(m, np.int64)
        for j in range(runs - 1, -1, -1):
            at[g[j : m + j] == low] = j
        at += np.arange(m)
        doc = np.repeat(np.arange(len(self.ends)), self.ends - self.starts)[:m]
        ok = np.flatnonzero(np.arange(m) + window <= self.ends[doc])
        if not len(ok):
            return none
        new = np.ones(len(ok), bool)
        new[1:] = (at[ok[1:]] != at[ok[:-1]]) | (doc[ok[1:]] != doc[ok[:-1]])
        first = ok[new]
        last = ok[np.append(np.flatnonzero(new)[1:] - 1, len(ok) - 1)]
        return g[at[first]], doc[first], first, last


def _mail(shards: np.ndarray, batch: int, a: np.ndarray) -> list[tuple]:
    """Rows of the sorted values for each shard."""
    cuts = np.flatnonzero(np.append(True, shards[1:] != shards[:-1])).tolist() if len(shards) else []
    return [(int(shards[i]), batch, a[i:j].tobytes(), None, None, None) for i, j in zip(cuts, [*cuts, len(shards)][1:], strict=True)]


def _table(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
    kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 4]
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in MAIL.split(", ")])


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, batch_chars: int = 3_000_000) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256, kept)``: one row per input row.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text, unchanged. Each word covered by ``window``
    consecutive words that also stand in a document with a smaller id is removed; kept words are
    joined by one space. Windows are judged on the input. Null and empty texts have no words. Rows
    that repeat an id are one document's and remove nothing from each other; a null id counts as
    larger than all, and such rows are dealt by their text. An empty table gives an empty result; other columns are not read. ``window``
    must be at least 7.

    The plan deals the texts out once (the exchange is reused by three passes). Batches and shards
    follow the input's size; a batch holds about ``batch_chars`` characters, a shard the anchors of
    as many.
    """
    if window <= RUN:
        raise ValueError(f"window must be above {RUN}")
    spark = docs.sparkSession
    total = docs.agg(F.coalesce(F.sum(F.length(text_col)), F.lit(0))).first()[0]
    n_batches = max(partitions(spark), -(-total // batch_chars))
    n_shards = n_batches

    def shard_of(f: np.ndarray) -> np.ndarray:
        return ((f >> np.uint64(40)) % np.uint64(n_shards)).astype(np.int64)

    def offer(key: tuple, table: pa.Table) -> pa.Table:
        """Pass 1: the chosen runs of a batch, each once; the lowest bit says that two of its documents hold it."""
        b = _Batch(table)
        f, doc, _, _ = b.anchors(window)
        order = np.lexsort((b.marks[doc], f))
        f, mark = f[order], b.marks[doc][order]
        start = np.append(True, f[1:] != f[:-1]) if len(f) else np.zeros(0, bool)
        group = np.flatnonzero(start)
        two = mark[group] != mark[np.append(group[1:], len(f)) - 1] if len(f) else np.zeros(0, bool)
        f = f[group]
        value = (f & ~np.uint64(1)) | two.astype(np.uint64)
        shards = shard_of(f)
        order = np.argsort(shards, kind="stable")
        return _table(_mail(shards[order], key[0].as_py(), value[order]))

    def repeated(key: tuple, table: pa.Table) -> pa.Table:
        """A shard's answer: to each batch its runs that another document holds."""
        values = [np.frombuffer(a, np.uint64) for a in table["a"].to_pylist()]
        f = np.concatenate(values)
        at = np.repeat(np.arange(len(values)), [len(v) for v in values])
        bare = f & ~np.uint64(1)
        order = np.argsort(bare, kind="stable")
        start = np.flatnonzero(np.append(True, bare[order][1:] != bare[order][:-1]))
        many = np.diff(np.append(start, len(f))) > 1
        many |= np.bitwise_or.reduceat(f[order] & np.uint64(1), start).astype(bool)
        yes = np.zeros(len(f), bool)
        yes[order] = np.repeat(many, np.diff(np.append(start, len(f))))
        batches = table["batch"].to_pylist()
        bounds = np.append(0, np.cumsum([len(v) for v in values]))
        return _table([(0, batches[i], bare[bounds[i] : bounds[i + 1]][yes[bounds[i] : bounds[i + 1]]].tobytes(), None, None, None) for i in np.unique(at[yes]).tolist()])

    def passages(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        """Pass 2: the passages around repeated runs, each once, to the runs' shards; where they stand stays with the batch."""
        if not answers.num_rows or not table.num_rows:
            return _table([])
        batch, b = key[0].as_py(), _Batch(table)
        f, doc, first, last = b.anchors(window)
        wanted = np.unique(np.concatenate([np.frombuffer(a, np.uint64) for a in answers["a"].to_pylist()]))
        bare = f & ~np.uint64(1)
        spot = np.minimum(np.searchsorted(wanted, bare), len(wanted) - 1)
        hit = np.flatnonzero(wanted[spot] == bare)
        words, known, oldest, run = b.words, {}, [], []
        place = np.empty(len(hit), np.int64)
        marks = b.marks[doc[hit]].tolist()
        for i, (h, x, z, mark) in enumerate(zip(hit.tolist(), first[hit].tolist(), last[hit].tolist(), marks, strict=True)):
            passage = b" ".join(words[x : z + window])
            at = known.get(passage)
            if at is None:
                at = known[passage] = len(oldest)
                oldest.append(mark)
                run.append(h)
            elif mark < oldest[at]:
                oldest[at] = mark
            place[i] = at
        texts, run_f = list(known), f[np.array(run, np.int64)]
        shards = shard_of(run_f)
        order = np.lexsort((run_f, shards))
        rows, low = [], np.array(oldest, np.int64)
        cuts = np.flatnonzero(np.append(True, shards[order][1:] != shards[order][:-1])).tolist() if len(order) else []
        for i, j in zip(cuts, [*cuts, len(order)][1:], strict=True):
            some = order[i:j]
            text = [texts[k] for k in some.tolist()]
            rows.append((int(shards[some[0]]), batch, some.astype(np.int64).tobytes(), low[some].tobytes(), run_f[some].tobytes(), b"\n".join(text)))
        rows.append((n_shards + batch, batch, place.astype(np.int32).tobytes(), doc[hit].astype(np.int32).tobytes(), (first[hit] - b.starts[doc[hit]]).astype(np.int64).tobytes(), None))
        return _table(rows)

    def stream(key: tuple, table: pa.Table) -> pa.Table:
        """A shard's automata: to each batch the first document of each window of its passages. A batch's own rows pass through."""
        if key[0].as_py() >= n_shards:
            return _table([(1, *[table[c][i].as_py() for c in ("batch", "a", "b", "c", "d")]) for i in range(table.num_rows)])
        groups: dict[int, dict[bytes, int]] = {}
        mails = []
        for a, low, f, text in zip(*[table[c].to_pylist() for c in "abcd"], strict=True):
            texts = text.split(b"\n")
            runs = np.frombuffer(f, np.uint64).tolist()
            mails.append((a, runs, texts))
            for r, p, mark in zip(runs, texts, np.frombuffer(low, np.int64).tolist(), strict=True):
                held = groups.setdefault(r, {})
                if held.setdefault(p, mark) > mark:
                    held[p] = mark
        found = {r: window_marks(held, window) for r, held in groups.items()}
        out = []
        for batch, (a, runs, texts) in zip(table["batch"].to_pylist(), mails, strict=True):
            got = [found[r][p] for r, p in zip(runs, texts, strict=True)]
            out.append((0, batch, a, np.array([len(g) for g in got], np.int32).tobytes(), np.array([m for g in got for m in g], np.int64).tobytes(), None))
        return _table(out)

    def remove(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        """Pass 3: drop the covered words."""
        b = _Batch(table)
        gone = np.zeros(len(b.words) + 1, np.int64)
        mails = answers.to_pylist()
        own = [m for m in mails if m["shard"] == 1]
        if own:
            place, doc, start = (np.frombuffer(own[0][c], k) for c, k in (("a", np.int32), ("b", np.int32), ("c", np.int64)))
            got = [m for m in mails if m["shard"] == 0]
            index = np.concatenate([np.frombuffer(m["a"], np.int64) for m in got])
            count = np.concatenate([np.frombuffer(m["b"], np.int32) for m in got]).astype(np.int64)
            marks = np.concatenate([np.frombuffer(m["c"], np.int64) for m in got])
            offset, size = np.zeros(len(index), np.int64), np.zeros(len(index), np.int64)
            offset[index], size[index] = np.cumsum(count) - count, count
            n = size[place]
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            older = marks[np.repeat(offset[place], n) + inner] < np.repeat(b.marks[doc], n)
            at = (np.repeat(b.starts[doc] + start, n) + inner)[older]
            np.add.at(gone, at, 1)
            np.add.at(gone, at + window, -1)
        covered = np.cumsum(gone[:-1]) > 0
        rows = []
        for d, s, e in zip(b.ids, b.starts.tolist(), b.ends.tolist(), strict=True):
            off = covered[s:e]
            words = [b.words[s + i] for i in np.flatnonzero(~off).tolist()] if off.any() else b.words[s:e]
            kept = b" ".join(words)
            rows.append((d, e - s, e - s - len(words), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace")))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        kinds = [pa.int64()] * 3 + [pa.string()] * 2
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in OUT.split(", ")])

    dealt = docs.select(
        F.pmod(F.xxhash64(F.lit(17), F.col(id_col).cast("long"), F.when(F.col(id_col).isNull(), F.col(text_col))), F.lit(n_batches)).alias("batch"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    )
    batches = dealt.groupBy("batch")
    offers = batches.applyInArrow(offer, MAIL)
    answers = offers.groupBy("shard").applyInArrow(repeated, MAIL)
    sent = batches.cogroup(answers.groupBy("batch")).applyInArrow(passages, MAIL)
    marks = sent.groupBy("shard").applyInArrow(stream, MAIL)
    return batches.cogroup(marks.groupBy("batch")).applyInArrow(remove, OUT)


def remove_reference_spans(docs: DataFrame, reference: DataFrame, id_col: str = "doc_id", text_col: str = "text", ref_col: str = "text", window: int = 13, shard_words: int = 50_000, most_words: int = 2_000_000) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256, kept)`` after dropping every maximal span of at
    least ``window`` words that occurs in the reference.

    The reference is a bounded table (a benchmark): its words are counted first, and above
    ``most_words`` this raises ValueError, as its automata are broadcast. Null and empty texts on
    either side match nothing.
    """
    spark = docs.sparkSession
    n = reference.select(F.sum(F.coalesce(F.regexp_count(ref_col, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)))).first()[0] or 0
    if n > most_words:
        raise ValueError(f"the reference has {n} words; at most {most_words} are broadcast")
    texts = sorted({r[0] for r in reference.select(ref_col).where(F.col(ref_col).isNotNull()).collect()})
    shards: list[list[list[bytes]]] = [[]]
    size = 0
    for t in texts:
        words = words_of(t)
        if size and size + len(words) > shard_words:
            shards.append([])
            size = 0
        shards[-1].append(words)
        size += len(words)
    kept = spark.sparkContext.broadcast(shards)
    built: list[SuffixAutomaton] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not built:
            for shard in kept.value:
                built.append(SuffixAutomaton())
                for words in shard:
                    built[-1].add(words, 0)
        for batch in batches:
            rows = []
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                off = np.zeros(len(words), bool)
                for automaton in built:
                    for i, (n, _) in enumerate(automaton.matches(words, window)):
                        if n >= window:
                            off[i + 1 - n : i + 1] = True
                left = b" ".join([words[i] for i in np.flatnonzero(~off).tolist()])
                rows.append((d, len(words), int(off.sum()), hashlib.sha256(left).hexdigest(), left.decode("utf-8", "replace")))
            if rows:
                kinds = [pa.int64()] * 3 + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in OUT.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, OUT)
