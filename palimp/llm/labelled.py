"""Bounded samples of labelled texts, for classifiers."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkernel import U, mix, shingle_hashes, tokenize


def crc_of_id(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary"))


#: Bytes of a text of a sample at most; longer ones are scored, but not learnt from.
LONGEST = 1 << 20


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, train: Column, each: int, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST) -> list[tuple[str, int]]:
    """At most `each` texts of label 0 and of label 1, chosen by the hash of their id, among the labels for which `train` (of a column doc_id) holds; texts that repeat count once.

    Only the chosen ids go to the driver and back, and only their texts return: one of each id (of several, that with the smallest hash), of `longest` bytes at most. So the driver gets 2 * each * longest bytes at most.
    """
    known = labels.select(F.col("doc_id"), F.col(label_col).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1)).where(train).distinct()
    ids = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64(F.col("doc_id").cast("string"), F.lit(42)), "doc_id").limit(each)
        ids = part if ids is None else ids.union(part)
    spark = docs.sparkSession
    rows = ids.collect()  # 2 * each at most
    if not rows:
        return []
    chosen = spark.createDataFrame(rows, ids.schema)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where(F.octet_length("text") <= longest)
    texts = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return sorted({(r["text"], r["y"]) for r in texts.select("text", "y").collect()})


def without_near_copies(sample: list[tuple[str, int]], bands: int = 20, rows: int = 6) -> list[tuple[str, int]]:
    """The first of the texts of one label that share a band of minimum hashes of three-word shingles, directly or over others. Copies of one text are one piece of evidence, not many."""
    tok = tokenize(pa.array([t for t, _ in sample], pa.string()))
    h = tok.hashes()
    lead = list(range(len(sample)))

    def find(i: int) -> int:
        while lead[i] != i:
            lead[i] = lead[lead[i]]
            i = lead[i]
        return i

    seen: dict[tuple, int] = {}
    for i, (_, y) in enumerate(sample):
        s = shingle_hashes(h[tok.woff[i] : tok.woff[i + 1]], 3)
        if not len(s):
            continue
        least = [int(mix(s ^ U(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)).min()) for k in range(1, bands * rows + 1)]
        for b in range(bands):
            a, c = sorted((find(i), find(seen.setdefault((y, b, *least[b * rows : (b + 1) * rows]), i))))
            lead[c] = a
    return [x for i, x in enumerate(sample) if find(i) == i]
