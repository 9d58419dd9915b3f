"""Edit scripts: unique common elements first, then the shortest script between them; deletions before insertions."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = re.compile(r"\w+|\s+|[^\w\s]")
#: Size of the largest table that is kept, 32 MB.
TABLE_BITS = 1 << 28


def longest_increasing(seq: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence."""
    tops: list[int] = []
    at: list[int] = []
    back = [-1] * len(seq)
    for i, x in enumerate(seq):
        k = bisect_left(tops, x)
        if k == len(tops):
            tops.append(x)
            at.append(i)
        else:
            tops[k], at[k] = x, i
        back[i] = at[k - 1] if k else -1
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def _rows(a: list, b: list, keep: bool) -> list[int]:
    """Rows of the table of common lengths, one number each: bit j is 0 where the length grows at b[j]. All of them, or the last alone."""
    where: dict = {}
    for j, y in enumerate(b):
        where[y] = where.get(y, 0) | 1 << j
    full = (1 << len(b)) - 1
    row, rows = full, []
    for x in a:
        hit = row & where.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
        if keep:
            rows.append(row)
    return rows if keep else [row]


def _lengths(a: list, b: list) -> np.ndarray:
    """Common lengths of a with each beginning of b."""
    bits = np.unpackbits(np.frombuffer(_rows(a, b, False)[0].to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.r_[0, np.cumsum(bits == 0)]


def _matches(a: list, b: list, bits: int) -> list[tuple[int, int]]:
    if not a or not b:
        return []
    if len(a) > 1 and len(a) * len(b) > bits:
        half = len(a) // 2
        cut = int(np.argmax(_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]))
        return _matches(a[:half], b[:cut], bits) + [(half + i, cut + j) for i, j in _matches(a[half:], b[cut:], bits)]
    rows = _rows(a, b, True)
    i, j, out = len(a), len(b), []
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        elif i > 1 and not rows[i - 2] >> (j - 1) & 1:
            i -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def shortest_matches(a: list, b: list, bits: int = TABLE_BITS) -> list[tuple[int, int]]:
    """Matched positions of a shortest edit script: a longest common subsequence from a table of bits. Tables of more than `bits` are halved first, so memory stays bounded."""
    n, m = len(a), len(b)
    lo = 0
    while lo < n and lo < m and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < n - lo and hi < m - lo and a[n - 1 - hi] == b[m - 1 - hi]:
        hi += 1
    x, y = a[lo : n - hi], b[lo : m - hi]
    # elements of one side only can't match
    common = set(x) & set(y)
    p, q = ([i for i, v in enumerate(s) if v in common] for s in (x, y))
    inner = [(lo + p[i], lo + q[j]) for i, j in _matches([x[i] for i in p], [y[j] for j in q], bits)]
    return [(i, i) for i in range(lo)] + inner + [(n - hi + i, m - hi + i) for i in range(hi)]


def anchors_of(a: list, b: list) -> list[tuple[int, int]]:
    """Positions of elements that occur once in both, in an order that increases in both."""
    ca, cb = Counter(a), Counter(b)
    where = {x: j for j, x in enumerate(b) if cb[x] == 1}
    pairs = [(i, where[x]) for i, x in enumerate(a) if ca[x] == 1 and x in where]
    return [pairs[k] for k in longest_increasing([j for _, j in pairs])]


def matches_of(a: list, b: list) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    i = j = 0
    for p, q in [*anchors_of(a, b), (len(a), len(b))]:
        out += [(i + x, j + y) for x, y in shortest_matches(a[i:p], b[j:q])]
        if p < len(a):
            out.append((p, q))
        i, j = p + 1, q + 1
    return out


def script_of(a: list, b: list, matches=matches_of) -> list[tuple[str, int | None, int | None]]:
    """(op, position in a, position in b): '=' both, '-' a only, '+' b only."""
    out: list[tuple[str, int | None, int | None]] = []
    i = j = 0
    for p, q in [*matches(a, b), (len(a), len(b))]:
        out += [("-", x, None) for x in range(i, p)] + [("+", None, y) for y in range(j, q)]
        if p < len(a):
            out.append(("=", p, q))
        i, j = p + 1, q + 1
    return out


def words_of(text: str) -> list[str]:
    return WORD.findall(text)


def value_script(a: str, b: str, split=words_of) -> list[dict]:
    """Runs of equal, removed and added values. Between words, white space counts as equal to white space, and the old one is shown."""
    x, y = list(split(a)), list(split(b))
    key = lambda t: " " if split is words_of and t.isspace() else t
    out: list[dict] = []
    for op, i, j in script_of([key(t) for t in x], [key(t) for t in y]):
        value = x[i] if i is not None else y[j]
        if out and out[-1]["op"] == op:
            out[-1]["value"] += value
        else:
            out.append({"op": op, "value": value})
    return out


def _comparable(text: str) -> tuple[str, list[str], list[str]]:
    """The trimmed, lower-cased text, its words, and what they are compared by."""
    t = text.strip().lower()
    words = words_of(t)
    return t, words, [" " if w.isspace() else w for w in words]


def word_similarities(a: list[str | None], b: list[str | None]) -> list[float | None]:
    """Twice the characters of words in common over both lengths, of the trimmed, lower-cased texts. Texts that repeat are cut into words once."""
    seen: dict[str, tuple[str, list[str], list[str]]] = {}
    out: list[float | None] = []
    for x, y in zip(a, b, strict=True):
        if x is None or y is None:
            out.append(None)
            continue
        for t in (x, y):
            if t not in seen:
                seen[t] = _comparable(t)
        (s, words, p), (t, _, q) = seen[x], seen[y]
        if s == t or not s or not t:
            out.append(float(s == t))
        else:
            out.append(min(1.0, 2 * sum(len(words[i]) for i, _ in matches_of(p, q)) / (len(s) + len(t))))
    return out


def word_similarity_of(a: str | None, b: str | None) -> float | None:
    return word_similarities([a], [b])[0]


SCRIPT = T.ArrayType(T.StructType([T.StructField("op", T.StringType()), T.StructField("old_no", T.IntegerType()), T.StructField("new_no", T.IntegerType())]))
_SCRIPT = pa.list_(pa.struct([("op", pa.string()), ("old_no", pa.int32()), ("new_no", pa.int32())]))
VALUES = T.ArrayType(T.StructType([T.StructField("op", T.StringType()), T.StructField("value", T.StringType())]))
_VALUES = pa.list_(pa.struct([("op", pa.string()), ("value", pa.string())]))


@F.arrow_udf(SCRIPT)
def edit_script(a: pa.Array, b: pa.Array) -> pa.Array:
    """Of two arrays of lines."""
    out = [None if x is None or y is None else [{"op": o, "old_no": i, "new_no": j} for o, i, j in script_of(x, y)] for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)]
    return pa.array(out, _SCRIPT)


@F.arrow_udf(SCRIPT)
def region_script(a: pa.Array, b: pa.Array) -> pa.Array:
    """Of two arrays of lines between unique common lines: the shortest script, without looking for such lines again."""
    return pa.array([[{"op": o, "old_no": i, "new_no": j} for o, i, j in script_of(x, y, shortest_matches)] for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], _SCRIPT)


@F.arrow_udf(VALUES)
def word_diff(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([None if x is None or y is None else value_script(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], _VALUES)


@F.arrow_udf(VALUES)
def char_diff(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([None if x is None or y is None else value_script(x, y, list) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], _VALUES)


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def lis(a: pa.Array) -> pa.Array:
    return pa.array([None if x is None else longest_increasing(x) for x in a.to_pylist()], pa.list_(pa.int32()))
