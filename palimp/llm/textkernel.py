"""Vectorised tokenising of Arrow string columns: words, word hashes and word shingles by numpy, without a Python loop over words.

Words are runs of bytes outside x20 and x09-x0D of the UTF-8 text, A-Z lower-cased. Hashes have 64 bits; a null text is empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text that are taken at once (a single longer text is taken whole, hashed by segments).
CHUNK = 1 << 20
SEGMENT = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Also ASCII punctuation and control characters separate words.
SPACE_PUNCT = np.ones(256, bool)
SPACE_PUNCT[128:] = False
SPACE_PUNCT[np.r_[48:58, 65:91, 97:123]] = False

_P = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2^64
_P_INV = pow(_P, -1, 1 << 64)
_M = (1 << 64) - 1
_tables: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _powers() -> tuple[np.ndarray, np.ndarray]:
    if not _tables:
        for name, base in (("p", _P), ("inv", _P_INV)):
            t = np.empty(SEGMENT + 1, U)
            t[0] = 1
            t[1] = base
            n = 1
            while n <= SEGMENT:
                m = min(n, SEGMENT - n + 1)
                if m <= 0:
                    break
                t[n : n + m] = t[:m] * U(pow(base, n, 1 << 64))
                n += m
            _tables[name] = t
    return _tables["p"], _tables["inv"]


def string_buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string array; null is empty."""
    if arr.null_count:
        arr = arr.fill_null("")
    kind = np.int64 if pa.types.is_large_string(arr.type) else np.int32
    _, off, data = arr.buffers()
    off = np.frombuffer(off, kind)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64) if len(arr) else np.zeros(1, np.int64)
    if data is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), off - off[0]
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def chunks(batch: pa.RecordBatch, text: str = "text", size: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `size` bytes of text each; every row is in one slice."""
    col = batch.column(batch.schema.get_field_index(text))
    _, off = string_buffers(col)
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        yield batch.slice(i, min(j, n) - i)
        i = min(j, n)


@dataclass
class Tokens:
    data: np.ndarray  # lower-cased bytes
    off: np.ndarray  # byte offsets of the texts
    start: np.ndarray  # of each word
    end: np.ndarray
    woff: np.ndarray  # word offsets of the texts

    @property
    def n(self) -> int:
        return len(self.off) - 1

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), np.diff(self.woff))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        p, inv = _powers()
        n = len(self.start)
        at_start, at_end = np.empty(n, U), np.empty(n, U)
        carry, size = U(0), len(self.data)
        back = np.empty(n, U)
        with np.errstate(over="ignore"):
            for base in range(0, max(size, 1), SEGMENT):
                seg = self.data[base : base + SEGMENT]
                s = np.empty(len(seg) + 1, U)
                s[0] = carry
                part = seg.astype(U)
                part += U(1)
                part *= p[: len(seg)]
                if base:
                    part *= U(pow(_P, base, 1 << 64))
                np.cumsum(part, out=s[1:])
                if carry:
                    s[1:] += carry
                a, b = np.searchsorted(self.start, (base, base + len(seg)))
                at_start[a:b] = s[self.start[a:b] - base]
                back[a:b] = inv[self.start[a:b] - base]
                if base:
                    back[a:b] *= U(pow(_P_INV, base, 1 << 64))
                a, b = np.searchsorted(self.end, (base + 1, base + len(seg) + 1))
                at_end[a:b] = s[self.end[a:b] - base]
                carry = s[-1]
            return mix((at_end - at_start) * back)


def tokenize(arr: pa.Array, space: np.ndarray = SPACE) -> Tokens:
    data, off = string_buffers(arr)
    sp = space[data]
    data = LOWER[data]
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    word = ~sp
    first, last = word.copy(), word.copy()
    if n:
        first[1:] &= sp[:-1] | edge[1:n]
        last[:-1] &= sp[1:] | edge[1:n]
    start = np.flatnonzero(first)
    return Tokens(data, off, start, np.flatnonzero(last) + 1, np.searchsorted(start, off))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k words of one text; a text of fewer words gives one hash of all, an empty text none."""
    n = len(words)
    if not n:
        return words
    m = min(n, k)
    with np.errstate(over="ignore"):
        h = words[: n - m + 1].copy()
        for j in range(1, m):
            h *= U(0xD1342543DE82EF95)
            h += words[j : n - m + 1 + j]
        h += U(m)
        return mix(h)


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))
