"""Linear-chain conditional random field with two labels: forward-backward over many sequences at once, and training on a bounded sample.

A sequence's positions have a score u for label 1 (label 0 has 0) and transitions have a 2x2 table. Sequences are cut into runs of equal length; the products of each run's
matrices are formed for all runs at once, combined along each sequence, and then messages run through all runs at once. So the work is linear in the
positions, and one very long sequence does not make it slow.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

import numpy as np


#: Positions whose messages are formed at once in training.
BLOCK = 200_000


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _filtered(u: np.ndarray, off: np.ndarray, t: np.ndarray, run: int) -> np.ndarray:
    """Log-odds of label 1 at each position given the positions up to it."""
    n = np.diff(off)
    runs = -(-n // run)
    roff = np.r_[0, np.cumsum(runs)]
    total = int(roff[-1])
    doc = np.repeat(np.arange(len(n)), n)
    pos = np.arange(len(u)) - off[doc]
    at = (pos % run) * total + roff[doc] + pos // run
    e1 = np.full(run * total, 0.5)
    e1[at] = _sigmoid(u)
    there = np.zeros(run * total, bool)
    there[at] = True
    e1, there = e1.reshape(run, total), there.reshape(run, total)
    first = np.zeros(total, bool)
    first[roff[:-1][n > 0]] = True

    def step(a0, a1, k):
        b0, b1 = a0 * t[0, 0] + a1 * t[1, 0], a0 * t[0, 1] + a1 * t[1, 1]
        if not k:
            half = (a0 + a1) / 2
            b0, b1 = np.where(first, half, b0), np.where(first, half, b1)
        b0, b1 = b0 * (1 - e1[k]), b1 * e1[k]
        return np.where(there[k], b0, a0), np.where(there[k], b1, a1)

    # what each run makes of (1, 0) and of (0, 1)
    m = np.stack([np.ones(total), np.zeros(total), np.zeros(total), np.ones(total)])
    for k in range(run):
        m[0], m[1] = step(m[0], m[1], k)
        m[2], m[3] = step(m[2], m[3], k)
        if k % 4 == 3 or k == run - 1:
            m /= m.sum(0)
    a0, a1 = np.full(total, 0.5), np.full(total, 0.5)
    who = np.flatnonzero(runs > 1)
    k = 0
    while len(who):
        r = roff[who] + k
        x0, x1 = a0[r] * m[0, r] + a1[r] * m[2, r], a0[r] * m[1, r] + a1[r] * m[3, r]
        a0[r + 1], a1[r + 1] = x0 / (x0 + x1), x1 / (x0 + x1)
        k += 1
        who = who[runs[who] > k + 1]
    out = np.empty((run, total))
    for k in range(run):
        a0, a1 = step(a0, a1, k)
        s = a0 + a1
        a0, a1 = a0 / s, a1 / s
        out[k] = np.log(np.maximum(a1, 1e-290)) - np.log(np.maximum(a0, 1e-290))
    return out.ravel()[at]


def forward_backward(u: np.ndarray, off: np.ndarray, transitions: np.ndarray, run: int = 32, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Marginal probability of label 1 at each position; and the expected number of each transition, if pairs."""
    t = np.exp(transitions - transitions.max())
    if not len(u):
        return np.zeros(0), np.zeros((2, 2))
    u = np.clip(u, -60, 60)
    ahead = _filtered(u, off, t, run)
    behind = _filtered(u[::-1], len(u) - off[::-1], t.T, run)[::-1]
    p = _sigmoid(ahead + behind - u)
    if not pairs:
        return p, None
    a, b = _sigmoid(ahead), _sigmoid(behind)
    inner = np.ones(len(u), bool)
    inner[off[1:][np.diff(off) > 0] - 1] = False
    i = np.flatnonzero(inner)
    x = np.stack([np.stack([(1 - a[i]) * t[0, 0] * (1 - b[i + 1]), (1 - a[i]) * t[0, 1] * b[i + 1]]), np.stack([a[i] * t[1, 0] * (1 - b[i + 1]), a[i] * t[1, 1] * b[i + 1]])])
    return p, (x / x.sum((0, 1))).sum(2)


class Features(Protocol):
    size: int

    def scores(self, w: np.ndarray) -> np.ndarray: ...

    def sums(self, x: np.ndarray) -> np.ndarray:
        """For each feature, the sum of x over the positions that have it."""


@dataclass
class Dense:
    x: np.ndarray

    @property
    def size(self) -> int:
        return self.x.shape[1]

    def scores(self, w):
        return self.x @ w

    def sums(self, x):
        return x @ self.x


@dataclass
class Hashed:
    """Several features of value 1 at each position, and a bias, the last. at: positions by kinds; kinds are taken one after the other, which keeps memory at a few arrays of the positions."""

    at: np.ndarray
    size: int

    def scores(self, w):
        out = np.full(len(self.at), w[-1])
        for k in range(self.at.shape[1]):
            out += w[self.at[:, k]]
        return out

    def sums(self, x):
        out = np.zeros(self.size)
        for k in range(self.at.shape[1]):
            part = np.bincount(self.at[:, k], x)
            out[: len(part)] += part
        out[-1] += x.sum()
        return out


def train(f: Features, off: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 1.0, steps: int = 60, rate: float = 0.3, run: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the features and transitions that maximise the regularised likelihood of the labels y: Adam on the exact gradient. weight: of each position."""
    w, t = np.zeros(f.size), np.zeros((2, 2))
    inner = np.ones(len(y), bool)
    inner[off[1:][np.diff(off) > 0] - 1] = False
    i = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[i], y[i + 1]), 1)
    n = max(1, len(y))
    # sequences in blocks of BLOCK positions or so, so that messages need little memory
    cuts = np.unique(np.r_[0, np.searchsorted(off, np.arange(BLOCK, len(y), BLOCK)), len(off) - 1])
    p = np.empty(len(y))
    m = [np.zeros(w.shape, np.float32), np.zeros_like(t)]
    v = [np.zeros(w.shape, np.float32), np.zeros_like(t)]
    for k in range(1, steps + 1):
        u, expected = f.scores(w), np.zeros((2, 2))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            p[off[a] : off[b]], some = forward_backward(u[off[a] : off[b]], off[a : b + 1] - off[a], t, run, True)
            expected += some
        gap = y - p if weight is None else (y - p) * weight
        for j, x in enumerate((w, t)):
            g = f.sums(gap) if j == 0 else seen - expected
            g -= l2 * x
            g /= n
            m[j] *= 0.9
            m[j] += 0.1 * g
            v[j] *= 0.99
            v[j] += 0.01 * g * g
            np.divide(m[j], 1 - 0.9**k, out=g)
            g /= np.sqrt(v[j] / (1 - 0.99**k)) + 1e-12
            g *= rate * (0.2 + 0.8 * (1 - k / steps))
            x += g
    return w, t
