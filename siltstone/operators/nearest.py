"""The numpy side of vector search: Arrow lists as matrices, and the best few of each question over a stream of batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Vectors compared with all questions of a block in one matrix product.
CHUNK = 1024


def matrix(lists: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of ``dim`` numbers, none of them null or not finite, as unit rows; and their places in ``lists``. Zero vectors stay zero."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    good = (sizes == dim) & lists.is_valid().to_numpy(zero_copy_only=False)
    at = np.flatnonzero(good)
    flat = lists.take(pa.array(at)).flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    found = flat.reshape(len(at), dim)
    finite = np.isfinite(found).all(1)
    return unit(found[finite]), at[finite]


def unit(rows: np.ndarray) -> np.ndarray:
    size = np.sqrt((rows * rows).sum(1, keepdims=True))
    return np.divide(rows, size, out=np.zeros_like(rows), where=size > 0)


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Halves away from zero, as Spark's round; never -0."""
    return np.sign(x) * np.floor(np.abs(x) * 10.0**digits + 0.5) / 10.0**digits + 0.0


class Best:
    """The k best (score, id) of each of some questions; equal scores go by the smaller id. Memory: questions times k, whatever is added."""

    def __init__(self, questions: int, k: int) -> None:
        self.k = k
        self.scores = np.full((questions, 0), 0.0)
        self.ids = np.empty((questions, 0), object)
        self.least = np.full(questions, -np.inf)

    def add(self, asked: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores (len(asked), len(ids)) of rows for the questions ``asked``, by their numbers."""
        wanted = np.flatnonzero(scores.max(1, initial=-np.inf) >= self.least[asked])
        if not len(wanted) or not len(ids):
            return
        order = np.argsort(ids, kind="stable")
        few = min(self.k, len(ids))
        new = scores[np.ix_(wanted, order)]
        # equal scores: the smaller id first, which a stable sort of the columns in id order keeps
        top = np.argsort(-new, axis=1, kind="stable")[:, :few]
        rows = asked[wanted]
        width = self.scores.shape[1]
        both = np.concatenate([self.scores[rows], np.take_along_axis(new, top, 1)], 1)
        named = np.concatenate([self.ids[rows], ids[order][top].astype(object)], 1)
        place = np.unique(named.astype(ids.dtype), return_inverse=True)[1].reshape(named.shape)
        # a question without k rows yet has empty places, worth less than any row
        sorted_ = np.lexsort((place, -both), axis=1)[:, : self.k]
        kept, names = np.take_along_axis(both, sorted_, 1), np.take_along_axis(named, sorted_, 1)
        if kept.shape[1] > width:
            grow = kept.shape[1] - width
            self.scores = np.concatenate([self.scores, np.full((len(self.scores), grow), -np.inf)], 1)
            self.ids = np.concatenate([self.ids, np.full((len(self.ids), grow), ids[0], object)], 1)
        self.scores[rows], self.ids[rows] = kept, names
        if self.scores.shape[1] == self.k:
            self.least = self.scores[:, -1].copy()

    def rows(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(question, scores, ids)."""
        for q in range(len(self.scores)):
            real = self.scores[q] > -np.inf
            if real.any():
                yield q, self.scores[q][real], self.ids[q][real]
