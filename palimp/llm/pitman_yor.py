"""Hierarchical Pitman-Yor language model, trained and applied at corpus scale.

Dishes are the most frequent words (DISHES of them at most, with the end of a text), and 256 classes of all other words, by a word's last bytes. Restaurants, from the root on:

* one of single dishes, whose base is uniform;
* one for each preceding dish, which shares the first as parent;
* one for each class, of the words in it, whose base is uniform over the class's words and one unknown word. So every word of the corpus, however rare, has its own probability;
* one for each preceding word that is no dish of its own, over all words: its parent is the restaurant of its class as preceding dish, with the class's restaurants below it for rare words;
* one for each preceding dish word and class that follows it, over the words of the class: its parent is the restaurant of the class.

So any word of the corpus is a context, and any a dish of it; contexts of a class share parents. Probabilities add up to 1 over the known words and an unknown one of each class.

Seating: Gibbs sampling of the numbers of tables, which is what the probabilities depend on: all customers of a dish are taken out and seated again at once. Given an auxiliary gamma variable of each restaurant and the parent's
weights (drawn from their Dirichlet posterior), the numbers of tables t of the dishes are independent: p(t) ~ S(c, t) * (d * y * p_parent)^t, S the generalised Stirling numbers. In the first two levels sweeps alternate these, and
the tables of children are the customers of the parent; the restaurants of words are sampled given the averaged probabilities of their parents. Predictive probabilities are averaged over the sweeps after the burn-in.

Scale. Counts cover all training texts. Word counts stay distributed; the driver sees bigram counts of dishes (DISHES squared at most), counts of counts, and the counts of the most frequent words (KNOWN at most), which the
executors get as a broadcast. The restaurants of words are dealt out by their hash: each task gets its restaurants' customers from all texts, in packed form (words by number, without probabilities, which follow from the broadcasts), samples them, and sends each text what its score changes by. The frequent pairs, of two dish
words, are in the broadcast matrix, so none of these restaurants holds a large share of the tokens. Counts of words beyond KNOWN are joined to the restaurants that such words occur in, so these too have the probability of their own count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .shared import written
from .textkernel import U, Tokens, as_long, chunks, mix, tokenize

DISHES, KNOWN, CLASSES = 2048, 1_000_000, 256
BURN_IN, SAMPLES, TABLES, EXACT = 6, 6, 256, 256
#: Sweeps of the restaurants of words; from this weight over the discount on, tables are drawn from the limit of many customers.
WORD_BURN_IN, WORD_SAMPLES, MANY = 2, 4, 64
#: Tokens that are counted at once; tokens and texts that are packed at once; tokens whose words' restaurants are one part.
HELD, PACK, PACK_TEXTS, PART = 2_000_000, 1_500_000, 65_000, 1_000_000
END = 0  # the end's key


def word_keys(tok: Tokens) -> np.ndarray:
    """A key of each word: a hash whose last byte is the class."""
    h = tok.hashes()
    d, n = tok.data, tok.end - tok.start
    end = np.zeros(len(h), U)
    for j in range(1, 4):
        end = end << U(8) | np.where(n >= j, d[np.maximum(tok.end - j, 0)] if len(d) else 0, 0).astype(U)
    return (h & ~U(255)) | (mix(end) >> U(56))


def with_ends(tok: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all tokens, an end after each text, and token offsets."""
    off = tok.woff + np.arange(tok.n + 1)
    out = np.full(off[-1], END, U)
    words = np.ones(off[-1], bool)
    words[off[1:] - 1] = False
    out[words] = word_keys(tok)
    return out, off


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def out() -> pa.RecordBatch:
        k, c = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([as_long(k), pa.array(c.astype(np.int64))], names=["k", "c"])

    for batch in batches:
        for part in chunks(batch):
            keys, _ = with_ends(tokenize(part.column(0)))
            held.append(keys)
            size += len(keys)
            if size >= HELD:
                yield out()
                held, size = [], 0
    if held:
        yield out()


def _count_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of each class and group of counts, with the smallest count."""
    for batch in batches:
        k, c = batch.column(0).to_numpy().view(U), batch.column(1).to_numpy()
        word = k != END
        k, c = k[word], c[word]
        group, place, n = np.unique((k & U(255)).astype(np.int64) << 48 | binned(c), return_inverse=True, return_counts=True)
        low = np.full(len(group), 1 << 62)
        np.minimum.at(low, place, c)
        yield pa.RecordBatch.from_arrays([pa.array(group >> 48), pa.array(group & (1 << 48) - 1), pa.array(low), pa.array(n)], names=["cls", "b", "low", "words"])


class Vocabulary:
    """The n most frequent words: sorted keys, counts and dish (0 if a word has none of its own). A word's number is its place; the end has n, any other word n + 1."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, least: int):
        order = np.argsort(keys)
        self.n = len(keys)
        self.keys, self.counts = np.r_[keys[order], U(END), U(END)], np.r_[counts[order], 0, 0]
        own = np.flatnonzero((self.counts[: self.n] >= least) & (self.keys[: self.n] != END))
        self.dish = np.zeros(self.n + 2, np.int16)
        self.dish[own] = np.arange(1, len(own) + 1)
        self.own = len(own)
        self.dishes = 1 + self.own + CLASSES

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys[: self.n], keys)
        return np.where(keys == END, self.n, np.where((self.keys[at] == keys) & (at < self.n), at, self.n + 1)).astype(np.uint32)

    def find(self, keys: np.ndarray, numbers: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Dish of each token, its count, and if the count is known here."""
        numbers = self.numbers(keys) if numbers is None else numbers
        dish = self.dish[numbers].astype(np.int64)
        rare = (dish == 0) & (keys != END)
        dish[rare] = 1 + self.own + (keys[rare] & U(255)).astype(np.int64)
        return dish, self.counts[numbers], numbers < self.n


def _count_pairs(got):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = got.value
        n = v.dishes
        total, held, size = np.zeros(n * n, np.int64), [], 0
        for batch in batches:
            for part in chunks(batch):
                keys, off = with_ends(tokenize(part.column(0)))
                dish, _, _ = v.find(keys)
                before = np.empty_like(dish)
                before[1:] = dish[:-1]
                before[off[:-1]] = 0
                held.append(before * n + dish)
                size += len(dish)
                if size >= HELD // 4:
                    total += np.bincount(np.concatenate(held), minlength=n * n)
                    held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=n * n)
        at = np.flatnonzero(total)
        for i in range(0, len(at), 200_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[i : i + 200_000]), pa.array(total[at[i : i + 200_000]])], names=["pair", "c"])

    return run


def binned(c: np.ndarray) -> np.ndarray:
    """Counts, those from EXACT on grouped by 1/16 of a doubling (as one of the group's counts)."""
    c = np.asarray(c, np.int64)
    big = c >= EXACT
    out = c.copy()
    out[big] = np.floor(2.0 ** ((np.floor(np.log2(c[big]) * 16) + 0.5) / 16)).astype(np.int64)
    return out


def log_stirling(cs: np.ndarray, d: float, tables: int = TABLES) -> dict[int, np.ndarray]:
    """log S(c, t), t = 1 to min(c, tables), of each c; beyond 65,536 customers the row of 65,536 stands in, as the shape of a row no longer changes while t is far below c^d."""
    top = 1 << 16
    want, out = {min(int(c), top) for c in cs}, {}
    t = np.arange(1, tables + 1)
    row = np.full(tables, -np.inf)
    row[0] = 0.0
    for c in range(1, max(want, default=0) + 1):
        if c in want:
            out[c] = row[: min(c, tables)].copy()
        with np.errstate(divide="ignore", invalid="ignore"):
            stay = np.log(np.maximum(c - t * d, 1e-300)) + row
        stay[t > c] = -np.inf
        row = np.logaddexp(stay, np.r_[-np.inf, row[:-1]])
    return {int(c): out[min(int(c), top)] for c in cs}


def sample_tables(c: np.ndarray, x: np.ndarray, s: dict[int, np.ndarray], rng: np.random.Generator, d: float) -> np.ndarray:
    """Numbers of tables of dishes with c customers, p(t) ~ S(c, t) x^t. For more than TABLES customers and a weight beyond MANY * d, t - 1 is drawn from its limit for many customers, the Poisson distribution of mean x / d."""
    out = np.ones(len(c), np.int64)
    group = binned(c)
    far = (c > TABLES) & (x > MANY * d)
    if far.any():
        out[far] = np.minimum(1 + rng.poisson(x[far] / d), c[far])
        group[far] = 1
    order = np.argsort(group, kind="stable")
    cs, start = np.unique(group[order], return_index=True)
    for k, value in enumerate(cs):
        if value < 2:
            continue
        at = order[start[k] : start[k + 1] if k + 1 < len(cs) else None]
        row = s[int(value)]
        t = np.arange(1, len(row) + 1)
        for i in range(0, len(at), 8192):
            part = at[i : i + 8192]
            p = row[None, :] + np.log(x[part])[:, None] * t[None, :]
            p -= p.max(1, keepdims=True)
            p = np.cumsum(np.exp(p), 1)
            out[part] = 1 + (p < (rng.random(len(part)) * p[:, -1])[:, None]).sum(1).clip(max=len(row) - 1)
    return out


def discount(counts: np.ndarray) -> float:
    n1, n2 = (counts == 1).sum(), (counts == 2).sum()
    return float(np.clip(n1 / (n1 + 2 * n2), 0.1, 0.9)) if n1 else 0.5


def context_probabilities(pair: np.ndarray, c: np.ndarray, dishes: int, theta: float = 1.0, seed: int = 7) -> np.ndarray:
    """Averaged predictive probabilities of each dish after each dish, as log10 (float32)."""
    rng = np.random.default_rng(seed)
    u, w = pair // dishes, pair % dishes
    d2, d1 = discount(c), 0.5
    s2 = log_stirling(np.unique(binned(c)), d2)
    customers = np.bincount(u, c, dishes)
    p1 = np.full(dishes, 1 / dishes)
    y = np.maximum(customers, 1.0) ** d2
    mean = np.zeros((dishes, dishes), np.float32)
    for sweep in range(BURN_IN + SAMPLES):
        t = sample_tables(c, d2 * y[u] * p1[w] + 1e-300, s2, rng, d2)
        tables = np.bincount(u, t, dishes)
        y = rng.gamma(theta / d2 + tables)
        up = np.bincount(w, t, dishes).astype(np.int64)
        some = up > 0
        if some.any():
            s1 = log_stirling(np.unique(binned(up[some])), d1)
            y1 = max(up.sum(), 1) ** d1 if sweep == 0 else rng.gamma(theta / d1 + t1.sum())  # noqa: F821
            t1 = np.zeros(dishes, np.int64)
            t1[some] = sample_tables(up[some], np.full(some.sum(), d1 * y1 / dishes), s1, rng, d1)
            beta = rng.dirichlet(np.r_[np.where(some, up - d1 * t1, 0) + 1e-9, theta + d1 * t1.sum()])
            p1 = beta[:-1] + beta[-1] / dishes
        if sweep >= BURN_IN:
            back = (theta + d2 * tables) / (theta + customers)
            mean += (back[:, None] * p1[None, :]).astype(np.float32)
            np.add.at(mean, (u, w), ((c - d2 * t) / (theta + customers[u])).astype(np.float32))
    return np.log10(mean / SAMPLES)


def class_probabilities(cls: np.ndarray, count: np.ndarray, words: np.ndarray, theta: float = 1.0, seed: int = 8) -> dict[tuple[int, int], float]:
    """Averaged predictive log10 probability of a word with a (binned) count in the restaurant of its class; count 0 is an unknown word. cls, count, words: words of a class that have a count."""
    rng = np.random.default_rng(seed)
    n1, n2 = words[count == 1].sum(), words[count == 2].sum()
    d = float(np.clip(n1 / (n1 + 2 * n2), 0.1, 0.9)) if n1 else 0.5
    s = log_stirling(np.unique(count), d)
    out = {}
    for k in range(CLASSES):
        at = np.flatnonzero(cls == k)
        cs, n = count[at], words[at]
        kinds, customers = int(n.sum()), int((cs * n).sum())
        base = 1 / (kinds + 1)
        y = max(customers, 1) ** d
        total, unknown = np.zeros(len(at)), 0.0
        for sweep in range(BURN_IN + SAMPLES):
            mean_t = np.ones(len(at))
            for i, c in enumerate(cs):
                if c > 1:
                    t = np.arange(1, len(s[int(c)]) + 1)
                    p = s[int(c)] + t * np.log(d * y * base)
                    p = np.exp(p - p.max())
                    mean_t[i] = (rng.multinomial(n[i], p / p.sum()) * t).sum() / n[i]
            tables = (mean_t * n).sum()
            y = rng.gamma(theta / d + tables)
            if sweep >= BURN_IN:
                back = (theta + d * tables) * base / (theta + customers)
                total += (cs - d * mean_t) / (theta + customers) + back
                unknown += back
        out[k, 0] = float(np.log10(unknown / SAMPLES))
        out |= {(k, int(c)): float(np.log10(x / SAMPLES)) for c, x in zip(cs, total, strict=True)}
    return out


def word_restaurants(r: np.ndarray, c: np.ndarray, p: np.ndarray, rng: np.random.Generator, theta: float = 1.0) -> np.ndarray:
    """Averaged predictive probability of each (restaurant, dish): numbers of restaurants from 0, customers (0 or more), and probabilities of the parent."""
    n = int(r.max(initial=-1)) + 1
    customers = np.bincount(r, c, n)
    d = discount(c)
    some = np.flatnonzero(c > 1)
    s = log_stirling(np.unique(binned(c[some])), d)
    t = (c > 0).astype(np.int64)
    y = np.maximum(customers, 1.0) ** d
    mean = np.zeros(len(c))
    for sweep in range(WORD_BURN_IN + WORD_SAMPLES):
        t[some] = sample_tables(c[some], d * y[r[some]] * p[some] + 1e-300, s, rng, d)
        tables = np.bincount(r, t, n)
        y = rng.gamma(theta / d + tables)
        if sweep >= WORD_BURN_IN:
            mean += (c - d * t + (theta + d * tables)[r] * p) / (theta + customers)[r]
    return mean / WORD_SAMPLES


PACKED = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("kind", pa.int8()), ("data", pa.binary())])
DDL = "part int, chunk long, kind tinyint, data binary"
ZSTD = pa.Codec("zstd", 1)


def _expand(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo[0], lo[0] + 1, ..., n[0] of them, then lo[1], ..."""
    return np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())


def _ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _from_ipc(data: bytes) -> pa.Table:
    with pa.ipc.open_stream(pa.py_buffer(data)) as r:
        return r.read_all()


def _split(*arrays: np.ndarray) -> bytes:
    """Arrays one after the other, with their sizes in bytes ahead: of each the first bytes of its numbers, then their second ones and so on, compressed."""
    data = b"".join(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes() for x in arrays)
    return np.array([x.nbytes for x in arrays], np.uint32).tobytes() + ZSTD.compress(data, asbytes=True)


def _joined(data: bytes, *kinds) -> list[np.ndarray]:
    at, out = 0, []
    sizes = np.frombuffer(data, np.uint32, len(kinds)).tolist()
    data = np.frombuffer(ZSTD.decompress(data[4 * len(kinds) :], sum(sizes)), np.uint8)
    for size, kind in zip(sizes, kinds, strict=True):
        out.append(data[at : at + size].reshape(np.dtype(kind).itemsize, -1).T.reshape(-1).view(kind))
        at += size
    return out


def _restaurants(before: np.ndarray, keys: np.ndarray, context: np.ndarray) -> np.ndarray:
    """The restaurant of a word after another: that of the other where it is a context of its own, else that of the other dish and the word's class."""
    with np.errstate(over="ignore"):
        return mix(before + np.where(context, U(0), (keys & U(255)) * U(0x9E3779B97F4A7C15) + U(1)))


def _seats(r: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A key of a word, of which 48 bits count, in its restaurant."""
    with np.errstate(over="ignore"):
        return mix(r * U(0xD1342543DE82EF95) + (w & U((1 << 48) - 1)))


def _of_class(keys: np.ndarray, count: np.ndarray, class_key: np.ndarray, class_p: np.ndarray) -> np.ndarray:
    """log10 probability of each word in the restaurant of its class."""
    want = (keys & U(255)).astype(np.int64) << 48 | binned(count)
    at = np.minimum(np.searchsorted(class_key, want), len(class_key) - 1)
    if not (class_key[at] == want).all():
        raise ValueError("a count is missing among the counts of counts")
    return class_p[at]


def _tails(got):
    """Words beyond the broadcast counts, with the restaurants that they occur in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = got.value
        for batch in batches:
            for part in chunks(batch):
                keys, off = with_ends(tokenize(part.column(0)))
                dish, _, known = v.find(keys)
                before, word = np.empty_like(dish), np.empty_like(keys)
                before[1:], word[1:] = dish[:-1], keys[:-1]
                before[off[:-1]], word[off[:-1]] = 0, END
                at = np.flatnonzero(~known & (keys != END))
                if len(at):
                    k, r = keys[at], _restaurants(word[at], keys[at], before[at] > v.own)
                    at = np.unique(_seats(r, k), return_index=True)[1]
                    yield pa.RecordBatch.from_arrays([as_long(k[at]), as_long(r[at])], names=["k", "r"])

    return run


def _pack_tails(parts: int):
    """Counts of words in restaurants (k, r, c), packed for each part (kind 2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            k, r, c = (np.concatenate([x[i] for x in held]) for i in range(3))
            part = (r >> U(40)) % U(parts)
            order = np.argsort(part, kind="stable")
            seats, c = _seats(r, k)[order], c[order].astype(np.uint32)
            cut = np.searchsorted(part[order], np.arange(parts + 1))
            for i in np.flatnonzero(np.diff(cut)).tolist():
                a, b = cut[i], cut[i + 1]
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([-1]), pa.array([2], pa.int8()), pa.array([_split(seats[a:b], c[a:b])], pa.binary())], schema=PACKED)

        for b in batches:
            if b.num_rows:
                held.append([b.column(0).to_numpy().view(U), b.column(1).to_numpy().view(U), b.column(2).to_numpy()])
                size += b.num_rows
            if size >= PACK:
                yield from out()
                held, size = [], 0
        if held:
            yield from out()

    return run


def _pack(model, parts: int):
    """For each chunk of texts: their rows (kind 0), dealt out by the chunk; and for each part the customers of its restaurants (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, log_p, class_key, class_p, n, kinds, ends = model.value
        chunk = TaskContext.get().partitionId() << 24
        norm = np.log10(n + 0.5 * (kinds + 1))
        rows, held, size, texts = [], [], 0, 0

        def out() -> Iterator[pa.RecordBatch]:
            docs = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
            # training texts first: their number tells them apart
            held_out = np.array(docs.column(1).to_numpy(zero_copy_only=False), bool)
            order = np.argsort(held_out, kind="stable")
            docs, place = docs.take(pa.array(order)), np.empty(len(order), np.uint16)
            place[order] = np.arange(len(order))
            train = np.array([len(order) - held_out.sum()], np.uint32)
            yield pa.RecordBatch.from_arrays([pa.array([chunk % parts], pa.int32()), pa.array([chunk]), pa.array([0], pa.int8()), pa.array([_ipc(docs)], pa.binary())], schema=PACKED)
            r, w, b, numbers, d = (np.concatenate([x.pop(0) for x in held]) for _ in range(5))
            held.clear()
            if not len(r):
                return
            d = place[d]
            with np.errstate(over="ignore"):
                h = mix(r * U(0xD1342543DE82EF95) + w)
            # by restaurant and word, then text: equal ones once, with their number
            order = np.argsort(h).astype(np.int32)
            h = h[order]
            new = np.r_[True, h[1:] != h[:-1]]
            del h
            pair = np.cumsum(new) - 1 << 16 | d[order]
            first = order[np.flatnonzero(new)]
            del order, new
            pair.sort()
            start = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
            times = np.diff(np.r_[start, len(pair)])
            pair = pair[start]
            which, text = pair >> 16, (pair & 0xFFFF).astype(np.uint16)
            del pair, start
            part = (r[first] >> U(40)) % U(parts)
            by_part = np.lexsort((r[first], part))
            start = np.searchsorted(which, np.arange(len(first) + 1))
            number = np.diff(start)
            cut = np.searchsorted(part[by_part], np.arange(parts + 1))
            for i in np.flatnonzero(np.diff(cut)).tolist():
                u = by_part[cut[i] : cut[i + 1]]
                m = number[u]
                take = _expand(start[u], m)
                f = first[u]
                lead = np.flatnonzero(np.r_[True, r[f[1:]] != r[f[:-1]]])
                # restaurants once, as what each adds to the one before, with their numbers of words; words by number, the others by key. The probabilities of the parents follow from these
                data = _split(np.diff(r[f[lead]], prepend=U(0)), np.diff(np.r_[lead, len(f)]).astype(np.uint32), b[f[lead]], numbers[f], w[f[numbers[f] > v.n]], m.astype(np.uint16), text[take], times[take].astype(np.uint32), train)
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([chunk]), pa.array([1], pa.int8()), pa.array([data], pa.binary())], schema=PACKED)

        for batch in batches:
            for part in (x.slice(i, PACK_TEXTS // 2) for x in chunks(batch) for i in range(0, x.num_rows, PACK_TEXTS // 2)):
                if texts + part.num_rows > PACK_TEXTS:
                    yield from out()
                    chunk += 1
                    rows, held, size, texts = [], [], 0, 0
                keys, off = with_ends(tokenize(part.column(1)))
                numbers = v.numbers(keys)
                dish, count, known = v.find(keys, numbers)
                end = keys == END
                count[end], known = ends, known | end
                before, word = np.empty_like(dish), np.empty_like(keys)
                before[1:], word[1:] = dish[:-1], keys[:-1]
                before[off[:-1]], word[off[:-1]] = 0, END
                of_dish = log_p[before, dish].astype(np.float64)
                rare = dish > v.own
                own = np.zeros(len(dish))
                at = np.flatnonzero(rare & known)  # of other words, whose count isn't known here, _seat adds it
                own[at] = _of_class(keys[at], count[at], class_key, class_p)
                base = np.where(known, np.log10(count + 0.5) - norm, 0.0)
                first = off[:-1]
                toff = np.r_[0, np.cumsum(~known)][off]
                tail = pa.ListArray.from_arrays(pa.array(toff.astype(np.int32)), as_long(keys[~known]))
                rows.append(pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(np.diff(off)), pa.array(np.add.reduceat((known & (count > 0)).astype(np.int64), first)), pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(of_dish + own, first)), tail], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "tail"]))
                context = before > v.own  # a word that is no dish
                deep = context | rare
                r = _restaurants(word[deep], keys[deep], context[deep])
                text = np.repeat(np.arange(texts, texts + part.num_rows), np.diff(off))[deep]
                held.append([r, keys[deep], np.where(context[deep], before[deep] - v.own, 0).astype(np.uint16), numbers[deep], text.astype(np.uint16)])
                size, texts = size + len(keys), texts + part.num_rows
                if size >= PACK:
                    yield from out()
                    chunk += 1
                    rows, held, size, texts = [], [], 0, 0
        if rows:
            yield from out()

    return run


def _seat(key: tuple, t: pa.Table, model: tuple) -> pa.Table:
    """Samples the restaurants of a part; for each chunk its rows, as they are, or what the scores of its texts change by."""
    v, log_p, class_key, class_p, *_ = model
    chunk, kind, data = (t.column(c).to_pylist() for c in ("chunk", "kind", "data"))
    out = {"part": [], "chunk": [], "kind": [], "data": []}
    pieces, tails = [], []
    for c, k, x in zip(chunk, kind, data, strict=True):
        if k == 0:
            pieces.append((c, None))
            for name, value in zip(out, (0, c, 0, x), strict=True):
                out[name].append(value)
        elif k == 2:
            tails.append(_joined(x, U, np.uint32))
        else:
            restaurants, words, before, numbers, others, *rest = _joined(x, U, np.uint32, np.uint16, np.uint32, U, np.uint16, np.uint16, np.uint32, np.uint32)
            w = v.keys[numbers]
            w[numbers > v.n] = others
            pieces.append((c, (np.repeat(np.cumsum(restaurants), words), w, np.repeat(before, words), *rest)))
    pieces = sorted((x for x in pieces if x[1]), key=lambda x: x[0])
    del data, t
    if pieces:
        r, w, before = (np.concatenate([x[i] for _, x in pieces]) for i in range(3))
        c = np.zeros(len(r))
        at = 0
        for _, x in pieces:
            who = np.repeat(np.arange(len(x[3])), x[3])
            c[at : at + len(x[0])] = np.bincount(who, x[5] * (x[4] < x[6]), len(x[0]))
            at += len(x[0])
        seats, first, place = np.unique(_seats(r, w), return_index=True, return_inverse=True)
        customers = np.bincount(place, c, len(first)).astype(np.int64)
        _, restaurant = np.unique(r[first], return_inverse=True)
        w, before = w[first], before[first]
        dish, count, known = v.find(w)
        missing = ~known & (w != END)
        p, at = np.where(before > 0, log_p[v.own + before.astype(np.int64), dish], np.float32(0)), np.flatnonzero(known & (dish > v.own))
        p[at] += _of_class(w[at], count[at], class_key, class_p)
        p = p.astype(np.float64)
        own = np.zeros(len(first))
        if missing.any():
            count = np.zeros(len(first), np.int64)
            for seat, c in tails:
                at = np.searchsorted(seats, seat)
                fits = (at < len(seats)) & (seats[np.minimum(at, len(seats) - 1)] == seat)
                count[at[fits]] = c[fits]
            own[missing] = _of_class(w[missing], count[missing], class_key, class_p)
        change = (np.log10(word_restaurants(restaurant, customers, 10.0 ** (p + own), np.random.default_rng(key[0].as_py()))) - p)[place]
        at = 0
        for number, x in pieces:
            each = np.repeat(change[at : at + len(x[0])], x[3]) * x[5]
            at += len(x[0])
            texts = np.unique(x[4])
            for name, value in zip(out, (0, number, 1, _split(np.diff(texts, prepend=np.uint16(0)), np.bincount(x[4], each)[texts].astype(np.float32))), strict=True):
                out[name].append(value)
    return pa.table(out, schema=PACKED)


def _scores(schema: pa.Schema):
    def run(t: pa.Table) -> pa.Table:
        """The rows of a chunk with the sums of what their scores change by, in the order of the parts."""
        kind, data = (t.column(c).to_pylist() for c in ("kind", "data"))
        docs = _from_ipc(data[kind.index(0)])
        score = docs.column("score").to_numpy().copy()
        for x in sorted(x for k, x in zip(kind, data, strict=True) if k):
            texts, change = _joined(x, np.uint16, np.float32)
            score[np.cumsum(texts)] += change
        return docs.set_column(docs.schema.get_field_index("score"), "score", pa.array(score)).append_column("row", pa.array((t.column("chunk")[0].as_py() << 17) + np.arange(docs.num_rows))).cast(schema)

    return run


def score_texts(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probability of the text), perplexity (of a token of the text) of each row, by a model of the rows that aren't held out.

    held_out: a condition on the column doc_id (null counts as not held out). Texts are taken whole, A-Z lower-cased; null is empty, which is one end. Repeated rows count each. Without training rows
    every word is unknown. Other columns are ignored.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    held = F.coalesce(held_out, F.lit(False))
    learn = base.where(~held).select("text")
    counts = written(learn.mapInArrow(_count_words, "k long, c long").groupBy("k").agg(F.sum("c").alias("c")), "words")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n, v = int(total[0]), int(total[1])
    # counts of counts, of a bounded number of groups, give the counts from which words are known to all, and have dishes
    bins = counts.select("k", "c").mapInArrow(_count_bins, "cls long, b long, low long, words long").groupBy("cls", "b").agg(F.min("low").alias("low"), F.sum("words").alias("words")).collect()
    groups: dict[int, list[int]] = {}
    for x in bins:
        g = groups.setdefault(x["b"], [1 << 62, 0])
        g[0], g[1] = min(g[0], x["low"]), g[1] + x["words"]

    def least(most: int) -> int:
        seen, out = 0, 1 << 62
        for _, (c, words) in sorted(groups.items(), reverse=True):
            seen += words
            if seen > most:
                break
            out = c
        return out

    known_from, dish_from = least(KNOWN), least(DISHES - CLASSES - 1)
    table = counts.where((F.col("c") >= known_from) & (F.col("k") != 0)).toArrow()
    vocabulary = Vocabulary(table.column("k").to_numpy().astype(np.int64).view(U), table.column("c").to_numpy().astype(np.int64), dish_from)
    ends = counts.where("k = 0").first()
    got = spark.sparkContext.broadcast(vocabulary)
    pairs = learn.mapInArrow(_count_pairs(got), "pair long, c long").groupBy("pair").agg(F.sum("c").alias("c")).toArrow()
    log_p = context_probabilities(pairs.column("pair").to_numpy().astype(np.int64), pairs.column("c").to_numpy().astype(np.int64), vocabulary.dishes)
    del pairs, table
    rare = sorted((x["cls"], x["b"], x["words"]) for x in bins if x["low"] < dish_from)
    of_class = class_probabilities(*(np.array([x[i] for x in rare], np.int64) for i in range(3)))
    keys = sorted(of_class)
    class_key, class_p = np.array([k << 48 | c for k, c in keys]), np.array([of_class[k] for k in keys])
    model = spark.sparkContext.broadcast((vocabulary, log_p, class_key, class_p, n, v, int(ends["c"]) if ends else 0))
    parts = max(24, n // PART)
    id_type = base.schema["doc_id"].dataType.simpleString()
    ddl = f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, base_score double, score double, tail array<long>, row long"
    packed = base.withColumn("held_out", held).mapInArrow(_pack(model, parts), DDL)
    rest = counts.where((F.col("c") < known_from) & (F.col("k") != 0))
    if v > vocabulary.n + (ends is not None):
        tails = base.select("text").mapInArrow(_tails(got), "k long, r long").join(rest, "k")
        packed = packed.union(tails.select("k", "r", "c").mapInArrow(_pack_tails(parts), DDL))
    seated = packed.groupBy("part").applyInArrow(lambda key, t: _seat(key, t, model.value), DDL)
    schema = to_arrow_schema(T._parse_datatype_string(ddl))
    scored = written(seated.groupBy("chunk").applyInArrow(_scores(schema), ddl), "scored")

    tail = scored.select("row", F.explode("tail").alias("k")).groupBy("row", "k").agg(F.count("*").alias("m")).join(rest, "k", "left").select("row", "m", F.coalesce("c", F.lit(0)).alias("c"))
    norm = float(np.log10(n + 0.5 * (v + 1)))
    tail = tail.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("m")).otherwise(0)).alias("known2"), F.sum(F.col("m") * (F.log10(F.col("c") + 0.5) - norm)).alias("base2"))
    out = scored.drop("tail").join(tail, "row", "left")
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known2", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("base_score") + F.coalesce("base2", F.lit(0.0))).alias("base_score"), "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
