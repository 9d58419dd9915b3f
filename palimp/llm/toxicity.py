"""Toxicity: a linear-chain conditional random field tags toxic tokens; documents are labelled, tokens are not, so their labels come first.

Token labels of the training sample: a clue is a feature (a word, or its first four to eight bytes) that is found a number of times or more in a text far more often if the text is toxic, and so
often that chance can't explain it in any of the features that as many texts have. The tokens with such a feature are labelled in the toxic texts that have it so often. The field then learns from words, beginnings and ends of words, and the transitions. Forward-backward marginals give spans (runs of tokens with a marginal of 1/2 or more) with offsets.

A document's score is a logistic function of the expected number of its toxic tokens, of its highest marginal, and of its length, since a long text holds words by chance that look like toxic ones. Its few weights are fitted
on a third of the sample, with marginals of a field that has learnt from the other two thirds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .crf import Hashed, _sigmoid, forward_backward, train
from .labelled import labelled_sample, without_near_copies
from .shared import give_back
from .textkernel import SPACE_PUNCT, Tokens, U, chunks, mix, tokenize

#: Texts of each label to learn from, at most; bits of a feature's hash; kinds of features, of which the last is no clue; likelihood ratio of a clue at least; largest number of times in a clue; how much less likely than one in all features chance must be (logarithm).
SAMPLE, BITS, KINDS, RATIO, TIMES, SURE = 1200, 18, 7, 15, 4, 3.0
ACCEPT = 0.7
#: Weights of 1, the logarithm of 1 + the expected number of toxic tokens, the highest marginal, and the logarithm of the length, before anything is learnt; and how much they weigh against a text.
PRIOR, TRUST = np.array([-4.0, 3.0, 3.0, 0.0]), 0.3


def token_features(tok: Tokens) -> np.ndarray:
    """Hashed features of each token: word, first four to eight bytes, last three bytes."""
    h, d = tok.hashes(), tok.data
    length = tok.end - tok.start
    top = len(d) - 1
    out = np.empty((len(h), KINDS), np.int32, order="F")  # kind by kind

    def put(k: int, x: np.ndarray) -> None:
        with np.errstate(over="ignore"):
            out[:, k] = (mix(x + U((k + 1) * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)) >> U(64 - BITS)).astype(np.int32) + (k << BITS)

    put(0, h)
    first = np.zeros(len(h), U)
    for j in range(8):
        first = first << U(8) | np.where(length > j, d[np.minimum(tok.start + j, max(top, 0))] if top >= 0 else 0, 0).astype(U)
        if j >= 3:
            put(j - 2, first)
    end = np.zeros(len(h), U)
    for j in range(1, 4):
        end = end << U(8) | np.where(length >= j, d[np.maximum(tok.end - j, 0)] if top >= 0 else 0, 0).astype(U)
    put(KINDS - 1, end)
    return out


@dataclass
class ToxicityModel:
    w: np.ndarray
    transitions: np.ndarray
    weights: np.ndarray  # of a document's score

    def tokens(self, col: pa.Array) -> tuple[np.ndarray, Tokens]:
        """Marginal of toxic of each token."""
        tok = tokenize(col, SPACE_PUNCT)
        at = token_features(tok)
        u = np.full(len(at), float(self.w[-1]))
        for k in range(KINDS):
            u += self.w[at[:, k]]
        p, _ = forward_backward(u, tok.woff, self.transitions, 64)
        return p, tok

    def spans(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Tokens]:
        """Scores of the texts; and of each span its text, first and last token (with a marginal each)."""
        p, tok = self.tokens(col)
        score = _sigmoid(document_features(p, tok.woff) @ self.weights)
        score[np.diff(tok.woff) == 0] = 0
        at = np.flatnonzero(p >= 0.5)
        doc = np.searchsorted(tok.woff, at, "right") - 1
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1])
        lo = np.flatnonzero(new)
        best = np.maximum.reduceat(p[at], lo) if len(lo) else np.zeros(0)
        return score, doc[lo], np.stack([at[lo], at[np.r_[lo[1:], len(at)] - 1]], 1) if len(lo) else np.zeros((0, 2), np.int64), best, tok

    def score(self, col: pa.Array) -> np.ndarray:
        return self.spans(col)[0]


def document_features(p: np.ndarray, off: np.ndarray) -> np.ndarray:
    """1, the logarithm of 1 + the expected number of toxic tokens, the highest marginal, and the logarithm of 1 + the number of tokens of each text."""
    n = np.diff(off)
    some = n > 0
    out = np.zeros((len(n), 4))
    out[:, 0] = 1
    out[:, 3] = np.log1p(n)
    if some.any():
        out[some, 1] = np.log1p(np.add.reduceat(p, off[:-1][some]))
        out[some, 2] = np.maximum.reduceat(p, off[:-1][some])
    return out


def fit_score(x: np.ndarray, y: np.ndarray, steps: int = 50) -> np.ndarray:
    """Logistic regression by Newton's method, drawn to PRIOR."""
    w = PRIOR.copy()
    for _ in range(steps):
        p = _sigmoid(x @ w)
        slope = x.T @ (y - p) - TRUST * (w - PRIOR)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + TRUST * np.eye(len(w)), slope)
        w = w + step * min(1, 2 / max(1e-9, np.abs(step).max()))
    return w


def token_labels(at: np.ndarray, off: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """1 for the tokens with a clue's feature, in the toxic texts that have it as often as the clue says."""
    doc = np.repeat(np.arange(len(toxic)), np.diff(off))
    width, size = len(toxic), 1 << BITS
    n1, n0 = max(1, toxic.sum()), max(1, (1 - toxic).sum())
    share = n1 / (n1 + n0)
    y = np.zeros(len(at), bool)
    for k in range(KINDS - 1):
        pair, place, times = np.unique((at[:, k].astype(np.int64) - (k << BITS)) * width + doc, return_inverse=True, return_counts=True)
        f, d = pair // width, pair % width
        labelled = np.zeros(len(pair), bool)
        for j in range(1, TIMES + 1):
            often = times >= j
            in1, in0 = np.bincount(f[often], toxic[d[often]], size), np.bincount(f[often], 1 - toxic[d[often]], size)
            some = np.flatnonzero((in1 / n1) / ((in0 + 0.5) / n0) >= RATIO)
            if not len(some):
                continue
            n = in1 + in0
            as_many = len(n) - np.searchsorted(np.sort(n), n[some])  # features that occur in as many texts
            a = np.clip(in1[some] / n[some], 1e-9, 1 - 1e-9)
            against_chance = n[some] * (a * np.log(a / share) + (1 - a) * np.log((1 - a) / (1 - share)))
            clue = np.zeros(size, bool)
            clue[some[(against_chance >= np.log(as_many) + SURE) & (a > share)]] = True
            labelled |= clue[f] & often
        y |= labelled[place]
    return y * toxic[doc]


def _fit_tokens(sample: list[tuple[str, int]], steps: int) -> tuple[np.ndarray, np.ndarray]:
    size = (KINDS << BITS) + 1
    if not any(y for _, y in sample):
        w = np.zeros(size)
        w[-1] = -20
        return w.astype(np.float32), np.zeros((2, 2))
    tok = tokenize(pa.array([t for t, _ in sample], pa.string()), SPACE_PUNCT)
    at = token_features(tok)
    y = token_labels(at, tok.woff, np.array([label for _, label in sample]))
    # clean texts hold most tokens; one of their tokens counts as it is, a labelled one as several
    weight = np.where(y == 1, 2.0, 1.0)
    w, t = train(Hashed(at, size), tok.woff, y, weight, 0.05, steps, 0.5, 64)
    return w.astype(np.float32), t


def fit_toxicity(sample: list[tuple[str, int]]) -> ToxicityModel:
    """Of texts that are near copies one counts. Without toxic texts to learn from, nothing is toxic."""
    weights, sample = PRIOR, without_near_copies(sample)
    if any(y for _, y in sample):
        by_label = sorted(sample, key=lambda x: (x[1], x[0]))  # a third of each label
        other = by_label[::3]
        part = ToxicityModel(*_fit_tokens([x for i, x in enumerate(by_label) if i % 3], 20), PRIOR)
        p, tok = part.tokens(pa.array([t for t, _ in other], pa.string()))
        weights = fit_score(document_features(p, tok.woff), np.array([y for _, y in other], np.float64))
    return ToxicityModel(*_fit_tokens(sample, 30), weights)


def learn_toxicity(docs: DataFrame, labels: DataFrame, train_on: Column, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    model = fit_toxicity(labelled_sample(docs, labels, "toxic", train_on, sample, id_col, text_col))
    give_back()
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, spans (array of start and end, in characters, and probability) of each row's whole text.

    Null and empty texts, and texts without a word, have score 0 and no spans; a score of ACCEPT or more, ties included, is toxic; repeated rows give a row each; other columns are ignored. No shuffle.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    got = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                score, doc, ends, best, tok = got.value.spans(part.column(1))
                spans: list[list[dict]] = [[] for _ in range(part.num_rows)]
                lead = np.r_[0, np.cumsum((tok.data & 0xC0) != 0x80)]  # characters before each byte
                for d, (a, b), p in zip(doc.tolist(), ends.tolist(), best.tolist(), strict=True):
                    zero = lead[tok.off[d]]
                    spans[d].append({"start": int(lead[tok.start[a]] - zero), "end": int(lead[tok.end[b]] - zero), "probability": p})
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), pa.array(spans, kind)], names=["doc_id", "score", "spans"])

    return base.mapInArrow(run, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, score double, spans array<struct<start:int,end:int,probability:double>>")
