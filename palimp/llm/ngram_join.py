"""N-gram Jaccard join by a blocked sparse product of the document by n-gram incidence matrix.

Rows of the matrix are classes of documents with equal n-gram sets. The product is only formed inside blocks of rows that can hold a link:

* Size-derived bounds. If two sets reach the threshold p/100, their sizes differ by a factor of at most 100/p, and they differ in at most
  e = 2*hi*(100-p)/(100+p) n-grams, hi the upper size of the level of the larger set. The hash space is cut into k = e + 1 + s ranges, so s + 1 ranges at least
  hold the same n-grams in both. A row emits a signature of each range at its own level, and at the next ones that a larger partner may have; it leaves out
  its s poorest ranges at most: those with a weight below some number, which keeps a common range in both. The weight counts n-grams that aren't common first, then all. So passages that
  many documents share make hardly any candidates. Rows that share no signature at the own level of one of them can't be linked.
* Rows that share signatures, directly or over others, form a candidate group. A group beyond PART is cut by set size into bands, and those by hash into blocks of bounded size;
  pairs of blocks whose sizes are too far apart are discarded. Block numbers come from sums by band, so no task sees a whole group.
* In each pair of blocks the product of the two incidence blocks accumulates overlap counts: by a dense product over n-grams of many rows, by
  enumerating over n-grams of few. Pairs below the bound are discarded there; what leaves the task is one row per linked row, never the pairs.

The result is exact up to collisions of 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .shared import written
from .textkernel import U, as_long, chunks, mix, shingle_hashes, tokenize

#: n-grams (each row counts ROW more) of a block of rows at most, and of a group that is one block; a larger group has some SPREAD blocks at least.
BLOCK, PART, SPREAD, ROW = 1_000_000, 60_000, 16, 1000
#: n-grams of a stretch in which common ones are looked for, the share of its texts that makes one common, and common ones at most.
HELD, COMMON, KNOWN = 2_000_000, 0.001, 1_000_000
#: Postings that a task combines at once; rows of one foreign level that share a signature there, from which on they are linked at once; postings of a part.
POSTS, MANY, PACK = 1_000_000, 8, 400_000
_LEVELS = [6]
while _LEVELS[-1] < 1 << 40:
    _LEVELS.append(_LEVELS[-1] * 6 // 5 + 1)


def _level(n: int) -> int:
    return int(np.searchsorted(_LEVELS, n))


def ranges(level: int, percent: int) -> tuple[int, int]:
    """k and slack s of a level: two linked sets differ in at most k - s - 1 ranges."""
    e = 2 * _LEVELS[level] * (100 - percent) // (100 + percent)
    s = 2 + e * 2 // 5
    return e + 1 + s, s


def signatures(h: np.ndarray, percent: int, common: np.ndarray) -> list[np.ndarray]:
    """The signatures of a sorted set of hashes, of its own level first; common: sorted hashes of common n-grams."""
    out, n = [], len(h)
    m = mix(h + U(0x5851F42D4C957F2D))
    rare = np.ones(n, np.int64)
    if len(common):
        rare = (common[np.minimum(np.searchsorted(common, h), len(common) - 1)] != h).astype(np.int64)
    for level in range(_level(n), _level(n * 100 // percent) + 1):
        k, slack = ranges(level, percent)
        bucket = ((h >> U(40)) * U(k)) >> U(24)
        first = np.r_[0, np.flatnonzero(bucket[1:] != bucket[:-1]) + 1]
        total, at = np.add.reduceat(m, first), bucket[first]
        weight = np.add.reduceat(rare, first) * 64 + np.minimum(np.diff(np.r_[first, n]), 63)
        least = 0 if k - len(at) > slack else np.partition(weight, slack - k + len(at))[slack - k + len(at)]
        if least:
            total, at = total[weight >= least], at[weight >= least]
        else:
            empty = np.setdiff1d(np.arange(k, dtype=U), at)
            total, at = np.r_[total, np.zeros(len(empty), U)], np.r_[at, empty]
        salt = U((level + 1) * 0x9FB21C651E98DF25 & 0xFFFFFFFFFFFFFFFF)
        out.append(mix(total + at * U(0xA24BAED4963EE407) + salt))
    return out


def _sets(batch: pa.RecordBatch, words: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], np.ndarray]]:
    """Chunks with the sorted set of each row and its class."""
    for part in chunks(batch):
        tok = tokenize(part.column(part.schema.get_field_index("text")))
        wh, off = tok.hashes(), tok.woff
        sets = []
        for i in range(tok.n):
            x = shingle_hashes(wh[off[i] : off[i + 1]], words)
            x.sort()
            sets.append(x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x)
        yield part, sets, np.array([class_of(x) for x in sets], U)


def class_of(h: np.ndarray) -> np.uint64:
    with np.errstate(over="ignore"):
        return mix(np.array([mix(h ^ U(0x2545F4914F6CDD1D)).sum(dtype=U) + U(len(h))], U))[0]


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, sets, cls in _sets(batch, words):
                n = np.array([len(x) for x in sets], np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n), pa.array(cls.view(np.int64), mask=n == 0)], names=["doc_id", "crc", "n_shingles", "cls"])

    return run


def _fresh(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[np.ndarray, int]]:
    """Sets and classes, copies in the same partition once (as far as a bounded memory goes; it only saves rows)."""
    seen: set[int] = set()
    for batch in batches:
        for _, sets, classes in _sets(batch, words):
            for h, c in zip(sets, classes.tolist(), strict=True):
                if len(h) and c not in seen:
                    if len(seen) < 1_000_000:
                        seen.add(c)
                    yield h, c


def _common(words: int):
    """n-grams that several texts of a stretch of HELD n-grams share, with their numbers there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            some = n >= max(8, COMMON * len(held))
            return pa.RecordBatch.from_arrays([as_long(h[some]), pa.array(n[some])], names=["gram", "n"])

        for h, _ in _fresh(batches, words):
            held.append(h)
            size += len(h)
            if size >= HELD:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    return run


def common_ngrams(texts: DataFrame, words: int) -> np.ndarray:
    """Hashes of common n-grams, KNOWN at most (the most common ones). Which they are changes the work, never the result."""
    found = written(texts.mapInArrow(_common(words), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")), "common")
    least = 0
    while found.where(F.col("n") >= least).count() > KNOWN:
        least = max(16, 2 * least)
    return np.sort(found.where(F.col("n") >= least).select("gram").toArrow().column(0).to_numpy().astype(np.int64).view(U))


def _hubs(sig: np.ndarray, cls: np.ndarray, far: np.ndarray, foreign: int) -> tuple[np.ndarray, ...]:
    """Links cls, hub of the rows that share a signature with its first row (own level before others, then the smallest class), where that has it at its own level or `foreign` rows share it; and which of the
    given postings remain: the first ones, and those that no link was made of."""
    order = np.argsort(sig)
    same = np.flatnonzero(sig[order[1:]] == sig[order[:-1]])
    several = np.zeros(len(sig), bool)
    several[order[same]] = several[order[same + 1]] = True
    some = np.flatnonzero(several)
    if not len(some):
        return cls[:0], cls[:0], order
    some = some[np.lexsort((cls[some], far[some], sig[some]))]
    g = sig[some]
    first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    n = np.diff(np.r_[first, len(g)])
    head = np.zeros(len(g), bool)
    head[first] = True
    hub, joined = np.repeat(cls[some[first]], n), ~head & np.repeat((far[some[first]] == 0) | (n >= foreign), n)
    stays = np.ones(len(sig), bool)
    stays[some[joined]] = False
    a, b = cls[some[joined]], hub[joined]
    a, b = a[a != b], b[a != b]
    with np.errstate(over="ignore"):
        _, once = np.unique(mix(a * U(3) + b), return_index=True)
    return a[once], b[once], order[stays[order]]


PACKED = pa.schema([("part", pa.int32()), ("sig", pa.binary()), ("cls", pa.binary()), ("far", pa.binary()), ("hub", pa.binary())])


def _signatures(words: int, percent: int, common, parts: int):
    """Postings of the rows (sig, cls, far: 0 if the level is the row's own, else 1), packed by the part of the signature; and links (cls, hub) of rows that share one in the same task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            sig, cls, far = (np.concatenate([x[i] for x in held]) for i in range(3))
            a, b, left = _hubs(sig, cls, far, MANY)
            sig, cls, far = sig[left], cls[left], far[left]
            part = ((sig >> U(32)) * U(parts) >> U(32)).astype(np.int32)
            cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(part) else np.zeros(1, np.int64)
            rows = [{"part": int(part[i]), "sig": sig[i:j].tobytes(), "cls": cls[i:j].tobytes(), "far": far[i:j].tobytes(), "hub": b""} for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            if len(a):
                rows.append({"part": int(a[0] % U(parts)), "sig": b"", "cls": a.tobytes(), "far": b"", "hub": b.tobytes()})
            return pa.RecordBatch.from_pylist(rows, PACKED)

        for h, c in _fresh(batches, words):
            for i, s in enumerate(signatures(h, percent, common.value)):
                held.append((s, np.full(len(s), c, U), np.full(len(s), min(i, 1), np.int8)))
                size += len(s)
            if size > POSTS:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    return run


def _links(t: pa.Table) -> pa.Table:
    """Links of the rows that share a signature in a part, and those made before."""
    get = lambda c, kind: np.frombuffer(b"".join(t.column(c).to_pylist()), kind)
    done = np.array([len(x) > 0 for x in t.column("hub").to_pylist()])
    a, b = (np.frombuffer(b"".join(t.column(c).filter(pa.array(done)).to_pylist()), U) for c in ("cls", "hub"))
    t = t.filter(pa.array(~done))
    x, y, _ = _hubs(get("sig", U), get("cls", U), get("far", np.int8), 1 << 62)
    return pa.table({"cls": as_long(np.r_[a, x]), "hub": as_long(np.r_[b, y])})


def _incidence(words: int):
    """Rows of the incidence matrix: the set of each fetched text as bytes; texts of another class that share an id fall away."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, sets, cls in _sets(batch, words):
                same = cls.view(np.int64) == part.column(part.schema.get_field_index("cls")).to_numpy()
                rows = pa.array([x.tobytes() for x in sets], pa.binary())
                keep = pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(c)) for c in ("root", "blk", "cls", "copies", "tasks")] + [rows], names=["root", "blk", "cls", "copies", "tasks", "grams"])
                yield keep.filter(pa.array(same))

    return run


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """The product of the incidence matrix of these rows and its transpose."""
    m = len(sets)
    out = np.zeros((m, m), np.float32)
    h = np.concatenate(sets)
    d = np.repeat(np.arange(m), [len(x) for x in sets])
    order = np.argsort(h, kind="stable")
    h, d = h[order], d[order]
    first = np.r_[0, np.flatnonzero(h[1:] != h[:-1]) + 1]
    length = np.diff(np.r_[first, len(h)])
    dense = first[length > 24], length[length > 24]
    for i in range(0, len(dense[0]), 2048):
        s, n = dense[0][i : i + 2048], dense[1][i : i + 2048]
        a = np.zeros((m, len(s)), np.float32)
        a[d[np.concatenate([np.arange(x, x + y) for x, y in zip(s, n, strict=True)])], np.repeat(np.arange(len(s)), n)] = 1
        out += a @ a.T
    half = np.zeros(m * m, np.float32)
    for n in range(2, 25):
        s = first[length == n]
        if not len(s):
            continue
        rows = d[s[:, None] + np.arange(n)]
        for i in range(n):
            for j in range(i + 1, n):
                at = rows[:, i] * m + rows[:, j]
                if len(at) * 8 > m * m:
                    half += np.bincount(at, minlength=m * m).astype(np.float32)
                else:
                    np.add.at(half, at, 1)
    half = half.reshape(m, m)
    out += half
    out += half.T
    return out


def _block(percent: int):
    def run(t: pa.Table) -> pa.Table:
        cls = t.column("cls").to_numpy()
        _, one = np.unique(cls, return_index=True)
        t = t.take(pa.array(one))
        cls, blk, copies = t.column("cls").to_numpy(), t.column("blk").to_numpy(), t.column("copies").to_numpy()
        sets = [np.frombuffer(x, U) for x in t.column("grams").to_pylist()]
        n = np.array([len(x) for x in sets], np.float64)
        o = overlaps(sets)
        link = np.empty(o.shape, bool)
        for i in range(0, len(n), 256):
            part = o[i : i + 256].astype(np.float64)
            link[i : i + 256] = 100 * part >= percent * (n[i : i + 256, None] + n[None, :] - part)
        del o
        np.fill_diagonal(link, False)
        if blk.min() != blk.max():
            link &= blk[:, None] != blk[None, :]
        links = link @ copies.astype(np.float64)
        label = np.arange(len(n))
        while True:
            new = np.minimum(label, np.where(link, label[None, :], len(n)).min(1))
            new = new[new]
            if (new == label).all():
                break
            label = new
        has = links > 0
        return pa.table({"cls": cls[has], "hub": cls[label][has], "links": links[has].astype(np.int64)})

    return run


def ngram_join(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Links documents whose sets of word n-grams have 100 * intersection >= percent * union.

    Returns a row per input row: doc_id, n_shingles, component_id (the smallest id reachable by links), n_links (documents linked with it, its copies
    included). Texts are taken whole, A-Z lower-cased, words without white space; fewer words than `words` are one n-gram. Null and empty texts have no
    n-gram, no link, and are their own component. A null id is never a component_id unless all ids of the component are null; repeated rows are documents of
    their own that are linked. Other columns are ignored. An empty table gives an empty result.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).select("doc_id", "text", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("crc"))
    id_type = base.schema["doc_id"].dataType.simpleString()
    sets = written(base.mapInArrow(_fingerprints(words), f"doc_id {id_type}, crc long, n_shingles long, cls long"), "sets")
    classes = sets.where("cls is not null").groupBy("cls").agg(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "crc"))).alias("known"), F.min("crc").alias("some"), F.count("*").alias("copies"), F.max("n_shingles").alias("n"))
    classes = written(classes.select("cls", F.col("known.doc_id").alias("rep"), F.coalesce("known.crc", "some").alias("crc"), "copies", "n"), "classes")

    common = docs.sparkSession.sparkContext.broadcast(common_ngrams(base.select("text"), words))
    # postings of a row: about twice its ranges, or its n-grams if they are fewer; parts of PACK postings
    ranges_of = F.lit(2.8 * 1.2 * (100 - percent) / (100 + percent)) * F.col("n") + 5
    posts = classes.agg(F.sum(2 * F.least(F.col("n"), ranges_of))).first()[0] or 0
    parts = max(24, int(posts) // PACK)
    near = base.select("text").mapInArrow(_signatures(words, percent, common, parts), "part int, sig binary, cls binary, far binary, hub binary").groupBy("part").applyInArrow(_links, "cls long, hub long")
    groups = connected_components(near, "cls", "hub")

    members = groups.withColumnRenamed("node", "cls").join(classes, "cls").withColumn("band", F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent)))
    bands = members.groupBy("root", "band").agg(F.sum(F.col("n") + ROW).alias("weight"))
    of_group = Window.partitionBy("root")  # a row for each band: some hundred at most
    bands = bands.withColumn("all", F.sum("weight").over(of_group))
    room = F.least(F.lit(BLOCK), F.greatest(F.lit(PART), F.col("all") / SPREAD))
    bands = bands.select(F.col("root").alias("r"), F.col("band").alias("b"), F.when(F.col("all") > PART, F.ceil(F.col("weight") / room)).otherwise(0).alias("cuts"))
    # an inner join, in which adaptive execution can split a group with many rows
    members = members.join(bands, (F.col("root") == F.col("r")) & (F.col("band") == F.col("b")))
    members = members.withColumn("blk", F.when(F.col("cuts") > 0, F.col("band") * (1 << 32) + F.pmod(F.xxhash64("cls"), F.col("cuts"))).otherwise(0))
    members = written(members.select("root", "cls", "rep", "crc", "copies", "n", "blk"), "members")
    blocks = members.groupBy("root", "blk").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    one, two = blocks.select("root", F.col("blk").alias("b1"), F.col("hi").alias("hi1")), blocks.select("root", F.col("blk").alias("b2"), F.col("lo").alias("lo2"))
    pairs = one.join(two, "root").where("b1 <= b2").where(F.col("hi1") * 100 >= F.col("lo2") * percent)  # bands rise with sizes
    pairs = pairs.select("root", "b1", "b2", F.explode(F.array_distinct(F.array("b1", "b2"))).alias("blk"))
    tasks = pairs.groupBy("root", "blk").agg(F.collect_list(F.struct("b1", "b2")).alias("tasks"))  # a number for each block of the group
    wanted = members.join(tasks, ["root", "blk"])
    fetched = base.join(wanted, base["doc_id"].eqNullSafe(wanted["rep"]) & (base["crc"] == wanted["crc"])).select("text", "root", "blk", "cls", "copies", "tasks")
    rows = fetched.mapInArrow(_incidence(words), "root long, blk long, cls long, copies long, tasks array<struct<b1:long,b2:long>>, grams binary")
    rows = rows.select("root", "blk", "cls", "copies", "grams", F.explode("tasks").alias("t")).select("root", "t.b1", "t.b2", "blk", "cls", "copies", "grams")
    found = rows.groupBy("root", "b1", "b2").applyInArrow(_block(percent), "cls long, hub long, links long")
    found = written(found, "found")

    linked = connected_components(found, "cls", "hub").withColumnRenamed("node", "cls")
    linked = linked.join(classes.select("cls", "rep"), "cls")
    lowest = linked.groupBy("root").agg(F.min("rep").alias("low"))
    counts = found.groupBy("cls").agg(F.sum("links").alias("links"))
    answer = classes.join(linked.select("cls", "root").join(lowest, "root").select("cls", "low"), "cls", "left").join(counts, "cls", "left")
    answer = written(answer.select("cls", F.coalesce("low", "rep").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")), "answer")
    return sets.join(answer, "cls", "left").select("doc_id", "n_shingles", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"), F.coalesce("links", F.lit(0)).alias("n_links"))
