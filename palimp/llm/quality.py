"""Quality classifier: a linear-chain conditional random field labels every line good or bad by features of the line and of its neighbours.

In training, a line has the label of its document. A document's quality is the mean of its lines' forward-backward marginals of good, weighted by length in bytes (plus one).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .crf import Dense, forward_backward, train
from .labelled import labelled_sample
from .shared import give_back
from .textkernel import chunks, string_buffers, tokenize

#: Texts of each label to learn from, at most.
SAMPLE = 1500
ACCEPT = 0.7
_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91] = 1  # upper case
_CLASS[97:123] = 2
_CLASS[128:] = 2
_CLASS[48:58] = 3
for _c in b"!#$%&*+/<=>@\\^_`|~":
    _CLASS[_c] = 4  # symbols
for _c in b"\"'(),-.:;?[]{}":
    _CLASS[_c] = 5  # punctuation
FEATURES = 15


def line_features(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of each line and of its neighbours, lengths in bytes, and line offsets of the texts; an empty text has one empty line."""
    raw, off = string_buffers(col)
    tok = tokenize(col)
    n = len(raw)
    breaks = np.flatnonzero(raw == 10)
    docs = len(off) - 1
    loff = np.arange(docs + 1) + np.searchsorted(breaks, off)
    # the lines' first bytes: those of the texts, and those after a break
    lo = np.empty(loff[-1], np.int64)
    doc_of_break = np.searchsorted(off, breaks, "right") - 1
    lo[loff[:-1]] = off[:-1]
    lo[np.arange(len(breaks)) + doc_of_break + 1] = breaks + 1
    hi = np.empty_like(lo)
    hi[:-1] = lo[1:] - 1
    hi[loff[1:] - 1] = off[1:]
    size = (hi - lo).astype(np.float64)
    kind = _CLASS[raw]

    def count(mask: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        s = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=s[1:])
        return (s[b] - s[a]).astype(np.float64)

    upper, lower, digit, symbol, punct = (count(kind == k, lo, hi) for k in range(1, 6))
    twice = np.zeros(n, bool)
    if n > 1:
        twice[1:] = (kind[1:] >= 4) & (raw[1:] == raw[:-1])
    twice = count(twice, lo, hi)
    h = tok.hashes()
    wa, wb = np.searchsorted(tok.start, lo), np.searchsorted(tok.start, hi)
    again = np.zeros(len(h), bool)
    again[1:] = h[1:] == h[:-1]
    near = again.copy()
    for k in (2, 3, 4):
        near[k:] |= h[k:] == h[:-k]
    bare = np.zeros(len(h), bool)  # words of symbols only
    bare[:] = kind[tok.start] >= 4
    bare &= tok.end - tok.start == 1
    again, near, bare = (count(x, wa, wb) for x in (again, near, bare))
    words = (wb - wa).astype(np.float64)
    w, s, letters = np.maximum(words, 1), np.maximum(size, 1), np.maximum(upper + lower, 1)
    own = np.stack([
        np.log1p(size), np.log1p(words), upper / letters, digit / s, symbol / s, punct / s, twice / w, again / w, near / w, bare / w, size / w,
        upper / letters > 0.5, symbol / s > 0.03, again / w > 0.25, bare / w > 0.15,
    ], 1)
    out = np.zeros((len(lo), 3 * FEATURES + 3))
    out[:, :FEATURES] = own
    first, last = np.zeros(len(lo), bool), np.zeros(len(lo), bool)
    first[loff[:-1]], last[loff[1:] - 1] = True, True
    if len(lo) > 1:
        out[1:, FEATURES : 2 * FEATURES] = np.where(first[1:, None], 0, own[:-1])
        out[:-1, 2 * FEATURES : 3 * FEATURES] = np.where(last[:-1, None], 0, own[1:])
    out[:, -3], out[:, -2], out[:, -1] = first, last, 1
    return out, size, loff


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    transitions: np.ndarray

    def lines(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Marginal of good of each line, its length, and line offsets."""
        x, size, off = line_features(col)
        p, _ = forward_backward(((x - self.mean) / self.scale) @ self.w, off, self.transitions, 8)
        return p, size, off

    def score(self, col: pa.Array) -> np.ndarray:
        if not len(col):
            return np.zeros(0)
        p, size, off = self.lines(col)
        weight = size + 1
        return np.add.reduceat(p * weight, off[:-1]) / np.add.reduceat(weight, off[:-1])


def fit_quality(sample: list[tuple[str, int]]) -> QualityModel:
    """Without labelled texts the score is 1/2 everywhere. Both labels weigh the same in all."""
    if not sample:
        return QualityModel(np.zeros(3 * FEATURES + 3), np.ones(3 * FEATURES + 3), np.zeros(3 * FEATURES + 3), np.zeros((2, 2)))
    x, _, off = line_features(pa.array([t for t, _ in sample], pa.string()))
    y = np.repeat([label for _, label in sample], np.diff(off))
    mean, scale = x.mean(0), x.std(0) + 1e-6
    mean[-1], scale[-1] = 0, 1
    share = max(y.mean(), 1e-3), max(1 - y.mean(), 1e-3)
    w, t = train(Dense((x - mean) / scale), off, y, np.where(y == 1, 0.5 / share[0], 0.5 / share[1]), 1.0, 150, 0.1, 8)
    return QualityModel(mean, scale, w, t)


def learn_quality(docs: DataFrame, labels: DataFrame, train_on: Column, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    model = fit_quality(labelled_sample(docs, labels, "quality", train_on, sample, id_col, text_col))
    give_back()
    return model


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score of each row's whole text. Null and empty texts have one empty line and get its score; repeated rows give a row each; other columns are ignored. No shuffle."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    got = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got.value.score(part.column(1)))], names=["doc_id", "score"])

    return base.mapInArrow(run, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, score double")


def line_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, line_no (from 0), good (marginal), n_bytes of every line."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    got = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                p, size, off = got.value.lines(part.column(1))
                doc = np.repeat(np.arange(part.num_rows), np.diff(off))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc)), pa.array((np.arange(len(p)) - off[doc]).astype(np.int32)), pa.array(p), pa.array(size.astype(np.int64))], names=["doc_id", "line_no", "good", "n_bytes"])

    return base.mapInArrow(run, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, line_no int, good double, n_bytes long")


def keep_scored(docs: DataFrame, model, keep, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose score passes `keep` (a function of an array of scores)."""
    got = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text_col):
                yield part.filter(pa.array(keep(got.value.score(part.column(part.schema.get_field_index(text_col)))), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
