"""Benchmark decontamination: a BM25 inverted index of test items, searched by block-max WAND with every passage of the training texts.

Passages. Items are sorted by length into classes of at most 64, 128, 256, ... words. For a class of at most n words, a text's passages are stretches of 4n words that begin at every 2n-th word, so
every stretch of 2n words lies in one passage. A passage is contaminated by an item if it holds `similarity` or more of the distinct word shingles of the item's question, and of its answer.

Thresholds. An impact is a term's BM25 weight divided by the item's score for itself, so a passage that holds all words of an item scores 1. A passage that passes the verification lacks m shingles
at most of the question and of the answer together, so m different words at most (2m where a shingle repeats in the item). Hence its score is 1 less the m largest impacts at least. That is the item's threshold: all passages above it are retrieved,
exactly, and none that would be verified lies below. Impacts in the index are divided by it, so that 1 is the threshold of all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkernel import SPACE_PUNCT, chunks, shingle_hashes, tokenize

#: Words of an item of the first class at most; blocks of an index; cells whose scores are added up at once.
SHORT, BLOCKS, CELLS = 64, 64, 1 << 21
K1, B = 1.2, 0.75
#: Bytes of item text in one index (the index takes 2 to 4 times that in each Python worker); more items are searched by further indexes, one after the other.
INDEX_BYTES = 8 << 20


@dataclass
class ItemIndex:
    stride: int  # words from one passage to the next; a passage has twice as many
    terms: np.ndarray  # sorted hashes
    ptr: np.ndarray  # postings of each term
    rows: np.ndarray  # row of each posting
    impact: np.ndarray  # in units of the row's threshold
    top: np.ndarray  # largest impact of each term
    block: int  # rows of a block
    entry_ptr: np.ndarray  # entries of each term: the blocks that it occurs in
    entry_block: np.ndarray
    entry_top: np.ndarray  # largest impact of the term in the block
    entry_at: np.ndarray  # first posting of each entry (and the end of the last)
    item: np.ndarray  # item of each row
    least: np.ndarray  # threshold of each row
    words: np.ndarray  # of each row
    parts: list  # of each row: (question shingles, k, answer shingles, k)

    def nbytes(self) -> int:
        return sum(x.nbytes for x in vars(self).values() if isinstance(x, np.ndarray)) + sum(q.nbytes + a.nbytes for q, _, a, _ in self.parts)


def _words(texts: list[str]) -> list[np.ndarray]:
    tok = tokenize(pa.array(texts, pa.string()), SPACE_PUNCT)
    h = tok.hashes()
    return [h[tok.woff[i] : tok.woff[i + 1]] for i in range(tok.n)]


def _shingles(words: np.ndarray, k: int) -> tuple[np.ndarray, int]:
    k = min(k, len(words))
    return (np.unique(shingle_hashes(words, k)) if k else words), k


def _may_lack(words: np.ndarray, shingles: np.ndarray, k: int, similarity: float) -> int:
    """How many different words a passage may lack that holds enough of these shingles."""
    lacks = len(shingles) - int(np.ceil(similarity * len(shingles) - 1e-9))
    return lacks if len(shingles) == len(words) - k + 1 else 2 * lacks


def _similar_together(rows: list) -> list:
    """In the order of which of the most common words they hold, so that the maxima of a block are those of similar rows."""
    common, count = np.unique(np.concatenate([np.unique(w) for _, w, *_ in rows]), return_counts=True)
    common = common[np.argsort(-count, kind="stable")[:24]]
    return sorted(rows, key=lambda x: (tuple(~np.isin(common, x[1])), len(x[1])))


def build_indexes(items: list[tuple[str | None, str | None]], k: int, similarity: float = 0.8) -> list[ItemIndex]:
    """An index for each class of lengths. items: question and answer; where the answer is null, the question is the whole item."""
    asked, answered = _words([q or "" for q, _ in items]), _words([a or "" for _, a in items])
    classes: dict[int, list] = {}
    for i, (q, a) in enumerate(zip(asked, answered, strict=True)):
        n = len(q) + len(a)
        if n:
            short, parts = (len(q) + len(a)) < k, (*_shingles(q, k), *_shingles(a, k))
            lack = 0 if short else _may_lack(q, *parts[:2], similarity) + _may_lack(a, *parts[2:], similarity)
            classes.setdefault(max(0, int(n - 1) // SHORT).bit_length(), []).append((i, np.concatenate([q, a]), parts, lack))
    return [_index(rows, 2 * SHORT << c) for c, rows in sorted(classes.items())]


def _index(rows: list, stride: int) -> ItemIndex:
    rows = _similar_together(rows)
    n = np.array([len(w) for _, w, _, _ in rows])
    words, row = np.concatenate([w for _, w, _, _ in rows]), np.repeat(np.arange(len(rows)), n)
    terms, term = np.unique(words, return_inverse=True)
    post, tf = np.unique(term * len(rows) + row, return_counts=True)
    term, row = post // len(rows), post % len(rows)
    df = np.bincount(term, minlength=len(terms))
    idf = np.log1p((len(rows) - df + 0.5) / (df + 0.5))
    w = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * n[row] / n.mean()))
    w /= np.bincount(row, w, len(rows))[row]
    by_row = np.lexsort((-w, row))
    ends = np.searchsorted(row[by_row], np.arange(len(rows) + 1))
    least = np.empty(len(rows))
    for i, (_, _, _, lack) in enumerate(rows):
        own = w[by_row[ends[i] : ends[i + 1]]]
        least[i] = max(own[lack:].sum(), own[-1])  # a shingle at least is there
    w = (w / least[row]).astype(np.float32)
    ptr = np.searchsorted(term, np.arange(len(terms) + 1))
    block = max(8, -(-len(rows) // BLOCKS))
    cell = term * BLOCKS + row // block
    entry_at = np.r_[np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]), len(cell)]
    entry_top = np.maximum.reduceat(w, entry_at[:-1])
    entry_ptr = np.searchsorted(cell[entry_at[:-1]] // BLOCKS, np.arange(len(terms) + 1))
    return ItemIndex(
        stride, terms, ptr.astype(np.int32), row.astype(np.int32), w, np.maximum.reduceat(entry_top, entry_ptr[:-1]), block, entry_ptr.astype(np.int32), (cell[entry_at[:-1]] % BLOCKS).astype(np.int8), entry_top, entry_at.astype(np.int32),
        np.array([i for i, *_ in rows]), least, n, [p for _, _, p, _ in rows],
    )


def _expand(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo[0], lo[0] + 1, ..., n[0] of them, then lo[1], ..."""
    return np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())


def block_max_wand(passage: np.ndarray, term: np.ndarray, ix: ItemIndex, least: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All (passage, row, score) with a score of `least` or more, for many passages at once: sorted pairs of a passage's number and a term of the index.

    WAND's tests in turn, on the index's aligned blocks: a passage whose lists' maxima don't add up to `least` has no pivot; a block whose maxima don't add up
    is skipped; the postings of the blocks that stay alive are added up, and what reaches `least` is returned.
    """
    start = np.r_[0, np.flatnonzero(passage[1:] != passage[:-1]) + 1]
    floor = least - 1e-4
    pivot = np.add.reduceat(ix.top[term], start) >= floor
    found = [], [], []
    stop = np.r_[start[1:], len(term)]
    runs = np.flatnonzero(pivot)
    for i in range(0, len(runs), 2048):
        r = runs[i : i + 2048]
        n = stop[r] - start[r]
        t, who = term[_expand(start[r], n)], np.repeat(np.arange(len(r)), n)
        m = ix.entry_ptr[t + 1] - ix.entry_ptr[t]
        entry = _expand(ix.entry_ptr[t], m)
        cell = np.repeat(who * BLOCKS, m) + ix.entry_block[entry]
        alive = np.flatnonzero(np.bincount(cell, ix.entry_top[entry], len(r) * BLOCKS) >= floor)
        place = np.full(len(r) * BLOCKS, -1)
        place[alive] = np.arange(len(alive))
        cell = place[cell]
        order = np.flatnonzero(cell >= 0)
        order = order[np.argsort(cell[order], kind="stable")]
        cell, entry = cell[order], entry[order]
        each = max(1, CELLS // ix.block)
        for j in range(0, len(alive), each):
            a, b = np.searchsorted(cell, (j, j + each))
            e, m = entry[a:b], ix.entry_at[entry[a:b] + 1] - ix.entry_at[entry[a:b]]
            post = _expand(ix.entry_at[e], m)
            lives = alive[j : j + each]
            at = np.repeat((cell[a:b] - j) * ix.block - ix.entry_block[e].astype(np.int64) * ix.block, m) + ix.rows[post]
            score = np.bincount(at, ix.impact[post], len(lives) * ix.block)
            hit = np.flatnonzero(score >= floor)
            found[0].append(passage[start[r[lives[hit // ix.block] // BLOCKS]]])
            found[1].append(lives[hit // ix.block] % BLOCKS * ix.block + hit % ix.block)
            found[2].append(score[hit])
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in found)


def _overlap(near: np.ndarray, part: np.ndarray) -> float:
    """The share of the sorted hashes `part` that are among the sorted hashes `near`."""
    if not len(part):
        return 1.0
    if not len(near):
        return 0.0
    return float((near[np.minimum(np.searchsorted(near, part), len(near) - 1)] == part).mean())


def leaks(part: pa.RecordBatch, indexes: list[ItemIndex], similarity: float, k: int = 5) -> list[tuple[int, int, float, float, float]]:
    """Row, item, score, question overlap and answer overlap of each contaminated row and item; of its passages the one with the highest score counts, then the highest overlaps."""
    tok = tokenize(part.column(part.schema.get_field_index("text")), SPACE_PUNCT)
    h, off = tok.hashes(), tok.woff
    if not len(h):
        return []
    doc = tok.doc_of_word()
    place, size = np.arange(len(h)) - off[doc], np.diff(off)
    best: dict[tuple[int, int], tuple[float, float, float]] = {}
    for ix in indexes:
        at = np.minimum(np.searchsorted(ix.terms, h), len(ix.terms) - 1)
        known = np.flatnonzero(ix.terms[at] == h)
        count = np.maximum(-(-size // ix.stride) - 1, 1)  # passages of each text
        first = np.r_[0, np.cumsum(count)]
        d, no, t = doc[known], place[known] // ix.stride, at[known]
        n = len(ix.terms)
        ahead, behind = no < count[d], no > 0  # a word lies in the passage that begins in its stretch, and in the one before
        pairs = np.unique(np.r_[(first[d[ahead]] + no[ahead]) * n + t[ahead], (first[d[behind]] + no[behind] - 1) * n + t[behind]])
        if not len(pairs):
            continue
        number, row, score = block_max_wand(pairs // n, pairs % n, ix)
        order = np.argsort(number, kind="stable")
        last, near = -1, {}
        for i in order.tolist():
            if number[i] != last:
                last, near = int(number[i]), {}
                d = int(np.searchsorted(first, last, "right")) - 1
                a = off[d] + (last - first[d]) * ix.stride
                text = h[a : min(off[d + 1], a + 2 * ix.stride)]
            it, s = int(ix.item[row[i]]), float(score[i] * ix.least[row[i]])
            q, kq, w, kw = ix.parts[row[i]]
            if ix.words[row[i]] < k and len(text) != ix.words[row[i]]:
                continue
            for x in (kq, kw):
                if x and x not in near:
                    near[x] = np.unique(shingle_hashes(text, x)) if len(text) >= x else text[:0]
            got = s, _overlap(near.get(kq, q), q), _overlap(near.get(kw, w), w)
            if min(got[1:]) >= similarity - 1e-9 and got > best.get((d, it), (-1.0,)):
                best[d, it] = got
    return [(d, it, *x) for (d, it), x in sorted(best.items())]


def item_indexes(benchmark: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "item_id", text_col: str = "text", answer_col: str | None = None) -> Iterator[tuple[list[int], list[ItemIndex]]]:
    """Keys (see keyed_items) and indexes of each group of different items; a group's texts have about INDEX_BYTES, so each index is of bounded size however large the benchmark is."""
    items = keyed_items(benchmark, id_col, text_col, answer_col).groupBy("key", "q", "a").agg(F.lit(1).alias("one"))
    size = items.agg(F.sum(F.coalesce(F.octet_length("q"), F.lit(0)) + F.coalesce(F.octet_length("a"), F.lit(0)))).first()[0] or 0
    groups = max(1, -(-size // INDEX_BYTES))
    for g in range(groups):
        rows = items.where(F.pmod("key", F.lit(groups)) == g).orderBy("key", "q", "a").collect()
        indexes = build_indexes([(r["q"], r["a"]) for r in rows], words, similarity)
        if indexes:
            yield [r["key"] for r in rows], indexes


def keyed_items(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", answer_col: str | None = None) -> DataFrame:
    """item_id, key, q, a: the key is equal for equal items."""
    items = benchmark.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("q"), (F.col(answer_col) if answer_col else F.lit(None)).cast("string").alias("a"))
    return items.withColumn("key", F.xxhash64("q", F.lit(1), "a"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", answer_col: str | None = None) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap of each contaminated text and item.

    Words are runs of ASCII letters and digits and of bytes from 128 on, A-Z lower-cased. Null or empty texts and items match nothing. An item of fewer words than a shingle contaminates
    only texts that have just its words; an answer of fewer words is one shingle. Without an answer, question_overlap is that of the whole item and answer_overlap is 1. Repeated rows of docs, and
    repeated items, give a row each. Other columns are ignored. No shuffle of the texts: the index is broadcast, with a bounded size.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item int, score double, question_overlap double, answer_overlap double"
    names = ("score", "question_overlap", "answer_overlap")
    ids = keyed_items(benchmark, item_col, text_col="text", answer_col=answer_col).select("item_id", "key")
    out = None
    for keys, indexes in item_indexes(benchmark, words, similarity, item_col, "text", answer_col):
        got = spark.sparkContext.broadcast(indexes)

        def run(batches: Iterator[pa.RecordBatch], got=got) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in chunks(batch):
                    found = leaks(part, got.value, similarity, words)
                    if found:
                        rows, *rest = zip(*found, strict=True)
                        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), pa.array(rest[0], pa.int32()), *(pa.array(x, pa.float64()) for x in rest[1:])], names=["doc_id", "item", *names])

        part = base.mapInArrow(run, schema).join(F.broadcast(spark.createDataFrame(list(enumerate(keys)), "item int, key long")), "item").drop("item")
        out = part if out is None else out.union(part)
    if out is None:
        return base.limit(0).select("doc_id", F.lit(None).cast(ids.schema["item_id"].dataType).alias("item_id"), *(F.lit(0.0).alias(c) for c in names))
    return out.join(ids, "key").select("doc_id", "item_id", *names)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, words: int = 5, similarity: float = 0.8, text_col: str = "text", answer_col: str | None = None) -> DataFrame:
    """The rows of docs, with all their columns, that no item contaminates (as find_leaks defines it). Rows with null or empty texts stay."""
    for _, indexes in item_indexes(benchmark, words, similarity, answer_col=answer_col):
        got = docs.sparkSession.sparkContext.broadcast(indexes)

        def run(batches: Iterator[pa.RecordBatch], got=got) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in chunks(batch, text_col):
                    text = part.column(part.schema.get_field_index(text_col))
                    bad = {x[0] for x in leaks(pa.RecordBatch.from_arrays([text], names=["text"]), got.value, similarity, words)}
                    yield part.filter(pa.array([i not in bad for i in range(part.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
