"""Toxicity: a convolutional text classifier in numpy, with thresholds calibrated by language.

Words are embedded by hashing: the word and its n-grams pick rows of one table, and the
word's vector is their maximum, or 0, in each dimension. Filters of widths 1, 2 and 3 run over the words,
each keeps its maximum over the text, and a linear layer gives the logit. The table starts from
smoothed log-odds of each row between toxic and other training texts; then all weights are trained
by Adam on the logistic loss. Each language gets a threshold from rows kept out of training; the
logit is shifted so that this threshold scores 0.7. The language is guessed from the text itself.
All labelled rows count; many are trained on in parts, whose models are averaged after each epoch.
"""

from __future__ import annotations

import pickle
import string
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from siltstone.llm.common import release, stored

BUCKETS, DIM, FILTERS, WIDTHS, GRAMS = 1 << 20, 8, 8, (1, 2, 3), (4, 5, 6)
#: Distinct words whose vectors a Python worker remembers; emptied at this size.
CACHE = 300_000
CUT = 0.7
#: Texts of either kind that a row of the table is taken to have been met in beforehand.
PRIOR = 6.0
#: Power by which training texts of languages with few of them weigh more: 0 not at all, 1 until all languages weigh alike.
BALANCE = 1.0
#: Held-out texts of either kind at which a language's own threshold weighs as much as the common one.
SHRINK = 30.0
#: Labelled rows, and their characters, of a part that one task trains on.
PART, PART_CHARS = 4000, 1 << 25
#: Words of a text whose rows of the table are looked at together.
BLOCK = 20_000
#: Parts send counts and changes as whole numbers of this fraction.
UNIT = 1 << 24
STRIP = string.punctuation + "«»„“”‘’…–—¿¡"

# Frequent function words by language, to guess a text's language.
FUNCTION_WORDS = {
    "en": "the of and to in is that for it with as was on be by this are from at an or not".split(),
    "de": "der die und den von zu mit das des ist im dem nicht ein eine auf für sich auch".split(),
    "fr": "le les et des du une est que qui dans pour pas sur au par ce il ne se plus".split(),
    "es": "el los las del y en que por con una para su al lo como más o pero sus se".split(),
}
LANGUAGES = list(FUNCTION_WORDS)
_VOTES = {w: [i for i, ws in enumerate(FUNCTION_WORDS.values()) if w in ws] for ws in FUNCTION_WORDS.values() for w in ws}


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the embedding table for lower-cased words: itself, and its n-grams (of UTF-16 units) between marks.

    Returns one row per position with a column for each length of n-gram (0: none), the first
    position of each word, and each word's own row. All words are hashed together.
    """
    bare = [w.strip(STRIP) for w in words]
    data = [f"<{w}>".encode("utf-16-le", "surrogatepass") for w in bare]
    sizes = np.fromiter(map(len, data), np.int64, len(data)) // 2
    starts = np.cumsum(sizes) - sizes
    unit = np.frombuffer(b"".join(data) + bytes(2 * max(GRAMS)), np.uint16).astype(np.uint32)
    n = len(unit) - max(GRAMS)
    left = np.repeat(starts + sizes, sizes) - np.arange(n)
    h, out = np.zeros(n, np.uint32), np.zeros((n, len(GRAMS)), np.int32)
    for j in range(max(GRAMS)):
        h = (h ^ unit[j : n + j]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(13)
        if j + 1 in GRAMS:
            mixed = h * np.uint32(0x85EBCA77) + np.uint32(j)
            rows = 1 + (mixed ^ (mixed >> np.uint32(16))) % np.uint32(BUCKETS - 1)
            out[:, GRAMS.index(j + 1)] = np.where(left > j, rows, 0)
    digest = xxhash.xxh32_intdigest
    own = np.array([1 + digest(d, 5) % (BUCKETS - 1) if len(d) > 4 else 0 for d in data], np.int32)
    return out, starts, own


def votes(word: str) -> list[float]:
    """One vote, shared, for the languages whose function words hold the word."""
    got = _VOTES.get(word.strip(STRIP), ())
    return [float(i in got) / max(1, len(got)) for i in range(len(LANGUAGES))]


@dataclass
class Model:
    table: np.ndarray
    filters: list[np.ndarray]  # for each width: (width, DIM, FILTERS)
    bias: list[np.ndarray]
    out: np.ndarray
    base: float
    thresholds: dict[str, float] = field(default_factory=dict)

    def logits(self, vectors: np.ndarray, n: int) -> float:
        """For a text of n words: their vectors, then max(WIDTHS) zero rows."""
        every = vectors @ np.concatenate([f[j] for f in self.filters for j in range(len(f))], axis=1)
        total, at = self.base, 0
        for i, w in enumerate(WIDTHS):
            got = every[: n + 1, at : at + FILTERS]
            for j in range(1, w):
                got = got + every[j : n + 1 + j, at + j * FILTERS : at + (j + 1) * FILTERS]
            at += w * FILTERS
            total += float(np.maximum(got.max(0) + self.bias[i], 0) @ self.out[i])
        return total

    def score(self, logit: np.ndarray, language: np.ndarray) -> np.ndarray:
        """1 / (1 + e^-x) of the logit, shifted so that the language's threshold gives CUT."""
        limit = np.array([self.thresholds[k] for k in [*LANGUAGES, ""]])[language]
        x = np.clip(logit - limit + np.log(CUT / (1 - CUT)), -40, 40)
        return 1 / (1 + np.exp(-x))


def embed(table: np.ndarray, words: list[str]) -> np.ndarray:
    """Each word's vector: in each dimension the maximum of its rows and 0."""
    out = np.empty((len(words), DIM), np.float32)
    for at in range(0, len(words), 20_000):
        grams, starts, own = features(words[at : at + 20_000])
        high = table[grams[:, 0]]
        for i in range(1, len(GRAMS)):
            np.maximum(high, table[grams[:, i]], out=high)
        out[at : at + 20_000] = np.maximum(np.maximum.reduceat(high, starts), table[own])
    return np.maximum(out, 0, out=out)


class Embedder:
    """Vectors and language votes of the words of texts; each distinct word is worked out once."""

    def __init__(self, model: Model) -> None:
        self.model, self.known = model, {}
        self.rows, self.vote = np.zeros((0, DIM), np.float32), np.zeros((0, len(LANGUAGES)), np.float32)

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Logit and language of each text; language len(LANGUAGES) if no function word was met."""
        logit, lang = np.zeros(len(texts)), np.zeros(len(texts), int)
        some, size, first = [], 0, 0
        for i, t in enumerate(texts):
            some.append((t or "").lower().split())
            size += len(some[-1])
            if size > 500_000 or i == len(texts) - 1:
                logit[first : i + 1], lang[first : i + 1] = self._some(some)
                some, size, first = [], 0, i + 1
        return logit, lang

    def _some(self, texts: list[list[str]]) -> tuple[list[float], list[int]]:
        if len(self.known) >= CACHE:
            self.known, self.rows, self.vote = {}, self.rows[:0], self.vote[:0]
        known, old = self.known, len(self.known)
        places = [np.array([known.setdefault(w, len(known)) for w in words], np.int64) for words in texts]
        new = list(known)[old:]
        if new:
            self.rows = np.concatenate([self.rows, embed(self.model.table, new)])
            self.vote = np.concatenate([self.vote, np.array([votes(w) for w in new], np.float32)])
        logit, lang, pad = [], [], np.zeros((max(WIDTHS), DIM), np.float32)
        for at in places:
            logit.append(self.model.logits(np.concatenate([self.rows[at], pad]), len(at)))
            v = self.vote[at].sum(0)
            lang.append(int(v.argmax()) if v.any() else len(LANGUAGES))
        return logit, lang


class _Ragged:
    """The rows of the table for each distinct word of the training texts, one after another."""

    def __init__(self, words: list[str]) -> None:
        flat, sizes = [], []
        for at in range(0, len(words), 20_000):
            grams, starts, own = features(words[at : at + 20_000])
            ends = np.append(starts[1:], len(grams))
            both = np.concatenate([grams.ravel(), own])
            word = np.concatenate([np.repeat(np.arange(len(starts)), (ends - starts) * len(GRAMS)), np.arange(len(own))])
            keep = both > 0
            both, word = both[keep], word[keep]
            order = np.argsort(word, kind="stable")
            flat.append(both[order])
            sizes.append(np.bincount(word, minlength=len(own)))
        self.flat = np.concatenate(flat) if flat else np.zeros(0, np.int32)
        self.size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        self.start = np.cumsum(self.size) - self.size

    def of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of some words, and where each word's begin (with the end); row 0 stands before each word's own."""
        n = self.size[words] + 1
        ends = np.cumsum(n)
        inner = np.arange(n.sum()) - np.repeat(ends - n, n) - 1
        rows = self.flat[np.maximum(np.repeat(self.start[words], n) + inner, 0)]
        rows[inner < 0] = 0
        return rows, np.append(0, ends)


class _Part:
    """Labelled texts that are trained on together; those without words are left out."""

    def __init__(self, texts: list[str | None], toxic: np.ndarray) -> None:
        known: dict[str, int] = {}
        place = [np.array([known.setdefault(w, len(known)) for w in (t or "").lower().split()], np.int32) for t in texts]
        some = [i for i, at in enumerate(place) if len(at)]
        self.place, self.toxic = [place[i] for i in some], np.asarray(toxic, int)[some]
        self.ragged = _Ragged(list(known))
        spoken = np.zeros((len(known), len(LANGUAGES)))
        for i, w in enumerate(known):
            if got := _VOTES.get(w.strip(STRIP)):
                spoken[i, got] = 1 / len(got)
        told = [spoken[at].sum(0) for at in self.place]
        self.language = np.array([int(v.argmax()) if v.any() else len(LANGUAGES) for v in told], int)

    def tally(self) -> np.ndarray:
        """Number of texts by label and language."""
        out = np.zeros((2, len(LANGUAGES) + 1), np.int64)
        np.add.at(out, (self.toxic, self.language), 1)
        return out

    def counts(self, weights: np.ndarray) -> np.ndarray:
        """For each label and row of the table the weight of the texts that meet it."""
        out = np.zeros((2, BUCKETS), np.float32)
        for words, y, k in zip(map(np.unique, self.place), self.toxic.tolist(), self.language.tolist(), strict=True):
            rows = np.concatenate([self.ragged.of(words[at : at + BLOCK])[0] for at in range(0, len(words), BLOCK)])
            out[y, rows] += weights[y, k]  # a row that is met more than once is added to once
        return out


def _weights(tally: np.ndarray) -> np.ndarray:
    """Weights of texts by label and language, that raise languages with few texts of a label toward the others, by the power BALANCE; 1 on average."""
    out = np.ones(tally.shape)
    for y, counts in enumerate(tally):
        out[y] = (counts.sum() / np.maximum(1, (counts > 0).sum() * counts)) ** BALANCE
        out[y] /= max(1e-9, (out[y] * counts).sum() / counts.sum()) if counts.any() else 1
    return out


def _first(counts: np.ndarray, tally: np.ndarray, rng: np.random.Generator) -> Model:
    """The model before training.

    Dimensions 0 and 1 of the table hold the smoothed log-odds and its opposite, the others little noise; rows never met stay 0.
    """
    table = np.zeros((BUCKETS, DIM), np.float32)
    if tally.any():
        others, toxic = tally.sum(1)
        weight = max(1, others) / max(1, toxic)
        odds = np.log((counts[1] + PRIOR) / (counts[0] / max(1.0, weight) + PRIOR))
        table = _noise()
        table[:, 0], table[:, 1] = odds, -odds
        table[(counts.sum(0) == 0) | (np.arange(BUCKETS) == 0)] = 0
    m = Model(
        table,
        [rng.normal(0, 0.15, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS],
        [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        np.abs(rng.normal(0, 0.3, (len(WIDTHS), FILTERS))).astype(np.float32),
        -2.0,
    )
    for i in range(len(WIDTHS)):  # a filter of each width starts as the log-odds of one word
        m.filters[i][0, 0, 0], m.out[i, 0] = 1, 1.0 / (i + 1)
    return m


class _Steps:
    """Training steps of a model on the texts of one part; ``tally`` counts the texts of all parts."""

    def __init__(self, m: Model, part: _Part, tally: np.ndarray, rate: float) -> None:
        self.m, self.part, self.rate, self.step = m, part, rate, 0
        self.flat = _flat(m).ravel()  # the weights of m but its table are views of it
        self.first, self.second, self.grad = (np.zeros_like(self.flat) for _ in range(3))
        self.own, self.to = _views(self.flat), _views(self.grad)
        n, weights = tally.sum(1), _weights(tally)
        self.weighs = [n.sum() / max(1, 2 * n[y]) * weights[y, k] for y, k in zip(part.toxic.tolist(), part.language.tolist(), strict=True)]

    def epoch(self, rng: np.random.Generator) -> None:
        """All texts once, in random order."""
        for d in rng.permutation(len(self.part.place)).tolist():
            self._text(d)
        _put(self.m, self.flat)

    def _text(self, d: int) -> None:
        table, of, y = self.m.table, self.part.ragged.of, self.part.toxic[d]
        filters, bias, out, base = self.own
        words, place = np.unique(self.part.place[d], return_inverse=True)
        n, vectors = len(place), np.empty((len(words), DIM), np.float32)
        for i in range(0, len(words), BLOCK):
            rows, at = of(words[i : i + BLOCK])
            vectors[i : i + BLOCK] = np.maximum.reduceat(table[rows], at[:-1])
        x = np.zeros((n + max(WIDTHS), DIM))
        x[:n] = vectors[place]
        z, best, h = float(base[0]), [], []
        every, at = x @ np.concatenate([f[j] for f in filters for j in range(len(f))], axis=1), 0
        for i, w in enumerate(WIDTHS):
            got = every[: n + 1, at : at + FILTERS].copy()
            for j in range(1, w):
                got += every[j : n + 1 + j, at + j * FILTERS : at + (j + 1) * FILTERS]
            at += w * FILTERS
            best.append(got.argmax(0))
            h.append(np.maximum(got[best[i], np.arange(FILTERS)] + bias[i], 0))
            z += float(h[i] @ out[i])
        g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * self.weighs[d]
        to_filters, to_bias, to_out, to_base = self.to  # all of it is set
        to_base[0], spots, pulls = g, [], []
        for i, w in enumerate(WIDTHS):
            gh = g * out[i] * (h[i] > 0)
            to_out[i], to_bias[i][:] = g * h[i], gh
            for j in range(w):
                to_filters[i][j] = x[best[i] + j].T * gh
                spots.append(best[i] + j)
                pulls.append(filters[i][j].T * gh[:, None])
        spots, pulls = np.concatenate(spots), np.concatenate(pulls)
        self._step(self.grad)
        keep = (spots < n) & pulls.any(1)
        if keep.any():  # plain steps for the few rows that gave a maximum
            met, which = np.unique(place[spots[keep]], return_inverse=True)
            rows, at = of(words[met])
            e = table[rows]
            highest = np.repeat(np.maximum.reduceat(e, at[:-1]), np.diff(at), axis=0)
            hit = rows[np.minimum.reduceat(np.where(e == highest, np.arange(len(rows))[:, None], len(rows)), at[:-1])]
            pull = np.zeros((len(met), DIM))
            np.add.at(pull, which, pulls[keep])
            np.subtract.at(table, (hit, np.arange(DIM)), (self.rate * pull * (hit > 0)).astype(np.float32))

    def _step(self, grad: np.ndarray) -> None:
        """A step of Adam."""
        self.step += 1
        self.first += 0.1 * (grad - self.first)
        self.second += 0.001 * (grad * grad - self.second)
        self.flat -= (self.rate / 4) * (self.first / (1 - 0.9**self.step)) / (np.sqrt(self.second / (1 - 0.999**self.step)) + 1e-6)


def train(rows: list[tuple[str, int]], epochs: int = 4, rate: float = 0.02, seed: int = 3) -> Model:
    """Fit on (text, label) rows; a quarter of them is kept for the thresholds.

    With no toxic or no other row the model gives every text a low score.
    """
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    y = np.array([int(rows[i][1]) for i in order], int)
    held = np.arange(len(y)) % 4 == 3
    part = _Part([rows[i][0] for i in order[~held]], y[~held])
    tally = part.tally()
    m = _first(part.counts(_weights(tally)), tally, rng)
    steps = _Steps(m, part, tally, rate)
    for _ in range(epochs if tally.any(1).all() else 0):
        steps.epoch(rng)
    del part, steps
    logit, lang = Embedder(m).texts([rows[i][0] for i in order[held]])
    m.thresholds = _thresholds(logit, lang, y[held], 1 - y[held])
    return m


def _thresholds(logit: np.ndarray, lang: np.ndarray, toxic: np.ndarray, other: np.ndarray) -> dict[str, float]:
    """Each language's threshold, shrunk toward the common one; ``toxic`` and ``other`` texts have the logit and the language."""
    common = _threshold(logit, toxic, other)
    out = {"": common}
    for i, k in enumerate(LANGUAGES):
        own = lang == i
        rare = min(toxic[own].sum(), other[own].sum())
        out[k] = float((rare * _threshold(logit[own], toxic[own], other[own]) + SHRINK * common) / (rare + SHRINK)) if rare else common
    return out


def _threshold(logit: np.ndarray, toxic: np.ndarray, other: np.ndarray) -> float:
    """Midway between the neighbours of the cut that gives the best F1; 0 without both kinds."""
    if not toxic.sum() or not other.sum():
        return 0.0
    order = np.argsort(-logit, kind="stable")
    hits = np.cumsum(toxic[order])
    f1 = 2 * hits / (np.cumsum((toxic + other)[order]) + toxic.sum())
    good = np.flatnonzero(f1 == f1.max())
    k = int(good[len(good) // 2])
    ranked = logit[order]
    return float((ranked[k] + ranked[min(k + 1, len(ranked) - 1)]) / 2)


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """``id, text, label`` of every labelled document whose crc32 (of the id as text) has a remainder other than 1 by 3.

    An id labelled both ways is toxic; of an id's texts the first in order is used.
    """
    usable = labels.where((F.crc32(F.col(id_col).cast("string")) % 3 != 1) & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("_y"))
    got = docs.select(F.col(id_col).alias("_d"), F.col(text_col).cast("string").alias("_t")).where("_t IS NOT NULL").join(usable, F.col("_d") == F.col("_id"))
    return got.groupBy("_id", "_y").agg(F.min("_t").alias("_t")).select(F.col("_id").alias("id"), F.col("_t").alias("text"), F.col("_y").alias("label"))


def _noise() -> np.ndarray:
    """The table's first values, the same in every process."""
    out = np.random.default_rng(17).standard_normal((BUCKETS, DIM), np.float32)
    return np.multiply(out, np.float32(0.05), out=out)


def packed(model: Model) -> bytes:
    """The model without the values of its table that still are ``_noise``, which is most of those met."""
    same = model.table == _noise()
    return zlib.compress(pickle.dumps((replace(model, table=np.where(same, np.float32(0), model.table)), np.packbits(same)), 5), 1)


def unpacked(packed_model: bytes) -> Model:
    model, same = pickle.loads(zlib.decompress(packed_model))
    same = np.unpackbits(same).view(bool).reshape(BUCKETS, DIM)
    np.copyto(model.table, _noise(), where=same)
    return model


def _in_one(rows: DataFrame, made: Callable[[pa.Table], Model]) -> bytes:
    """The packed model that one task makes of rows whose number has a fixed bound; the driver only hands it on."""
    names = rows.schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = [b for b in batches if b.num_rows]
        if every:
            table = pa.Table.from_batches(every).sort_by([(n, "ascending") for n in names if n != "text"])
            yield pa.RecordBatch.from_arrays([pa.array([packed(made(table))], pa.binary())], names=["model"])

    got = rows.repartition(1).mapInArrow(run, "model binary").first()
    release(rows.sparkSession)
    return bytes(got[0]) if got else packed(train([]))


_STEP = ["row", *[f"d{i}" for i in range(DIM)]]


def fit(rows: DataFrame, epochs: int = 4, rate: float = 0.02, seed: int = 3) -> bytes:
    """The packed model fitted to all rows ``id, text, label``.

    Up to PART rows are one part, for ``train``. More are dealt to parts by the id's hash, and a quarter
    is kept for the thresholds. Counts are summed over all parts. In each epoch every part trains the
    same model on its own texts; the parts' changes of a row of the table are averaged over those that
    changed it, and of the other weights over all. Thresholds come from a histogram of all kept logits.
    Sums are of whole numbers, so that their order cannot change the model.
    """
    spark = rows.sparkSession
    rows = stored(rows.select("id", "text", F.col("label").cast("int").alias("label")))
    n, chars = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    parts = max(-(-n // PART), -(-chars // PART_CHARS))
    if parts <= 1:
        return _in_one(rows, lambda t: train(list(zip(t["text"].to_pylist(), t["label"].to_pylist(), strict=True)), epochs, rate, seed))
    held = F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(4)) == 3
    dealt = rows.select(F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part"), "id", "text", "label")
    fitted = dealt.where(~held).groupBy("part")

    def part_of(t: pa.Table) -> _Part:
        t = t.sort_by("id")
        return _Part(t["text"].to_pylist(), t["label"].to_numpy())

    def tallied(t: pa.Table) -> pa.Table:
        y, k = np.indices((2, len(LANGUAGES) + 1)).reshape(2, -1)
        return pa.table({"y": y, "k": k, "n": part_of(t).tally().ravel()})

    tally = np.zeros((2, len(LANGUAGES) + 1), np.int64)
    for r in fitted.applyInArrow(tallied, "y long, k long, n long").groupBy("y", "k").agg(F.sum("n").alias("n")).collect():
        tally[r.y, r.k] = r.n
    weights = _weights(tally)

    def counted(t: pa.Table) -> pa.Table:
        counts = part_of(t).counts(weights)
        at = np.flatnonzero(counts.any(0))
        return pa.table({"row": at.astype(np.int32), "c0": _whole(counts[0, at]), "c1": _whole(counts[1, at])})

    def begun(t: pa.Table) -> Model:
        counts = np.zeros((2, BUCKETS))
        for y in (0, 1):
            counts[y, t["row"].to_numpy()] = t[f"c{y}"].to_numpy() / UNIT
        return _first(counts, tally, np.random.default_rng(seed))

    def trained(sent: Broadcast, epoch: int) -> Callable:
        return lambda key, t: _changes(sent.value, part_of(t), tally, rate, [seed, epoch, key[0].as_py()])

    model = _in_one(fitted.applyInArrow(counted, "row int, c0 long, c1 long").groupBy("row").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")), begun)
    for epoch in range(epochs if tally.any(1).all() else 0):
        sent = spark.sparkContext.broadcast(model)
        steps = fitted.applyInArrow(trained(sent, epoch), "row int, " + ", ".join(f"{c} long" for c in _STEP[1:]))
        model = _in_one(steps.groupBy("row").agg(*[F.sum(c).alias(c) for c in _STEP[1:]], F.count("*").alias("n")), lambda t, sent=sent: _averaged(sent.value, t))
        sent.destroy()
    sent = spark.sparkContext.broadcast(model)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = Embedder(unpacked(sent.value))
        for b in batches:
            logit, lang = e.texts(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(np.rint(np.clip(logit, -40, 40) * 1000).astype(np.int64)), pa.array(lang), b.column("label")], names=["bin", "lang", "label"])

    def told(t: pa.Table) -> Model:
        m = unpacked(sent.value)
        n = t["n"].to_numpy()
        toxic = np.where(t["label"].to_numpy() == 1, n, 0)
        bins, at = np.unique(np.stack([t["bin"].to_numpy(), t["lang"].to_numpy()]), axis=1, return_inverse=True)
        of = lambda w: np.bincount(at.ravel(), w, bins.shape[1])
        m.thresholds = _thresholds(bins[0] / 1000, bins[1], of(toxic), of(n - toxic))
        return m

    kept = dealt.where(held).select("text", "label").mapInArrow(judged, "bin long, lang long, label int")
    model = _in_one(kept.groupBy("bin", "lang", "label").agg(F.count("*").alias("n")), told)
    sent.destroy()
    return model


def _changes(model: bytes, part: _Part, tally: np.ndarray, rate: float, seed: list[int]) -> pa.Table:
    """What an epoch on one part changes: rows of the table by their numbers, and the other weights by numbers below 0."""
    m = unpacked(model)
    old = replace(m, table=m.table.copy())
    _Steps(m, part, tally, rate).epoch(np.random.default_rng(seed))
    at = np.flatnonzero((m.table != old.table).any(1))
    rest = _flat(m) - _flat(old)
    d = _whole(np.concatenate([m.table[at] - old.table[at], rest]))
    return pa.table([np.append(at, -1 - np.arange(len(rest))).astype(np.int32), *d.T], names=_STEP)


def _averaged(model: bytes, changes: pa.Table) -> Model:
    """The model after the changes of all parts: sums, and the number ``n`` of parts that changed a row."""
    m, row = unpacked(model), changes["row"].to_numpy()
    d = np.stack([changes[c].to_numpy() for c in _STEP[1:]], 1) / (UNIT * changes["n"].to_numpy()[:, None])
    m.table[row[row >= 0]] += d[row >= 0]
    rest = _flat(m)
    rest[-1 - row[row < 0]] += d[row < 0]
    _put(m, rest)
    return m


def _whole(x: np.ndarray) -> np.ndarray:
    """Numbers as multiples of 1 / UNIT."""
    return np.rint(np.asarray(x, np.float64) * UNIT).astype(np.int64)


def _flat(m: Model) -> np.ndarray:
    """All weights but the table, filled up to rows of DIM."""
    flat = np.concatenate([np.ravel(p) for p in (*m.filters, *m.bias, m.out, m.base)]).astype(np.float64)
    return np.append(flat, np.zeros(-len(flat) % DIM)).reshape(-1, DIM)


def _views(flat: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray]:
    """Filters, bias, out and base within the numbers of ``_flat``."""
    found, at = [], 0
    for shape in (*[(w, DIM, FILTERS) for w in WIDTHS], *[(FILTERS,)] * len(WIDTHS), (len(WIDTHS), FILTERS), (1,)):
        size = int(np.prod(shape))
        found.append(flat[at : at + size].reshape(shape))
        at += size
    return found[: len(WIDTHS)], found[len(WIDTHS) : -2], found[-2], found[-1]


def _put(m: Model, flat: np.ndarray) -> None:
    filters, bias, m.out, base = _views(flat.ravel().astype(np.float32))
    m.filters, m.bias, m.base = filters, bias, float(flat.ravel()[sum(map(np.size, (*filters, *bias, m.out)))])


def score_documents(docs: DataFrame, model: Model | bytes, text_col: str = "text", score_col: str = "toxicity") -> DataFrame:
    """``docs`` with ``score_col double`` (0 to 1) and ``<score_col>_lang string`` added, all rows kept.

    Columns of the input with those two names are replaced. Null, empty and blank texts score as texts without words. Only the text is an input. Repeated
    rows get equal scores; an empty table gives an empty result.
    """
    kept = docs.sparkSession.sparkContext.broadcast(packed(model) if isinstance(model, Model) else model)
    held: dict[str, Embedder] = {}
    docs = docs.drop(score_col, f"{score_col}_lang")
    schema = StructType([*docs.schema.fields, StructField(score_col, DoubleType()), StructField(f"{score_col}_lang", StringType())])
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "e" not in held:
            held["e"] = Embedder(unpacked(kept.value))
        e = held["e"]
        names = np.array([*LANGUAGES, ""], object)
        for b in batches:
            logit, lang = e.texts(b.column(at).to_pylist())
            columns = [*b.columns, pa.array(e.model.score(logit, lang)), pa.array(names[lang], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", score_col: str = "toxicity") -> DataFrame:
    """Fit on all labelled rows that may be learnt from and score every document."""
    return score_documents(docs, fit(training_rows(docs, labels, id_col, text_col, label_col)), text_col, score_col)


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """The documents that score below the cut, with their own columns, whatever their names."""
    score = "toxicity"
    while score in docs.columns or f"{score}_lang" in docs.columns:
        score += "_"
    return classify(docs, labels, id_col, text_col, label_col, score).where(F.col(score) < CUT).select(*docs.columns)
