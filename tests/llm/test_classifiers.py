"""Held-out accuracy of the two classifiers on the provided labels; ties of scores and odd texts; near copies in a sample."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palimp.llm import labelled, quality, queries, toxicity

SF = "/root/testdata/sf0.01"


def held_out(spark, query, label):
    got = query(spark, SF).where("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where(F.col(label).isNotNull())
    rows = got.select("score", "predicted", F.col(label).alias("y")).collect()
    return (np.array([r[c] for r in rows]) for c in ("score", "predicted", "y"))


def test_toxicity_on_held_out_labels(spark):
    score, predicted, y = held_out(spark, queries.op8_crf_toxicity, "toxic")
    hit = (predicted == 1) & (y == 1)
    assert hit.sum() >= 0.8 * (y == 1).sum() and hit.sum() >= 0.9 * predicted.sum()
    assert (score[y == 1][:, None] > score[y == 0][None, :]).mean() > 0.9


def test_quality_on_held_out_labels(spark):
    score, predicted, y = held_out(spark, queries.op5_line_crf_quality, "quality")
    assert (score[y == 1][:, None] > score[y == 0][None, :]).mean() > 0.95
    assert ((predicted == 1) & (y == 1)).sum() >= 0.9 * (y == 1).sum() and ((predicted == 0) & (y == 0)).sum() >= 0.8 * (y == 0).sum()


def test_stems_with_many_endings():
    """Toxic words that share only their beginning, which clean texts hold now and then."""
    rng = np.random.default_rng(5)
    part = [a + b for a in "bcdfgklmnprst" for b in "aeiou"]
    word = lambda: "".join(rng.choice(part, rng.integers(2, 5)))
    clean = lambda n: [word() for _ in range(n)]

    def toxic(n):
        w = clean(n)
        for i in rng.choice(n, max(3, n // 30), replace=False):
            w[i] = "gubonadi" + word()
        return w

    sample = [(" ".join(clean(rng.integers(20, 300))), 0) for _ in range(200)] + [(" ".join(toxic(rng.integers(20, 300))), 1) for _ in range(40)]
    model = toxicity.fit_toxicity(sample)
    bad = model.score(pa.array([" ".join(toxic(150)) for _ in range(50)]))
    good = model.score(pa.array([" ".join(clean(150)) for _ in range(50)]))
    assert (bad >= toxicity.ACCEPT).mean() >= 0.9 and (good < toxicity.ACCEPT).all()


def test_near_copies_count_once():
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in rng.integers(0, 5000, 200)]
    copies = [(" ".join([*base[:k], "changed", *base[k + 1 :]]), 1) for k in range(0, 200, 10)]
    others = [(" ".join(f"w{i}" for i in rng.integers(0, 5000, 200)), int(k % 2)) for k in range(30)]
    assert len(labelled.without_near_copies(copies + others + [("", 1), ("", 1)])) == 1 + 30 + 2
    assert labelled.without_near_copies([]) == []


@pytest.mark.parametrize("text", ["", " \n", None, "!!! ---", "a" * 3_000_000, "idiot " * 200_000])
def test_odd_texts(text):
    for model in (toxicity.fit_toxicity([("you idiot " + str(i), 1) for i in range(20)] + [(f"good day {i}", 0) for i in range(20)]), quality.fit_quality([("good line\nanother", 1), ("$$$ ### !!!", 0)])):
        a, b = model.score(pa.array([text, text], pa.string()))
        assert a == b and 0 <= a <= 1


def test_sample_is_bounded(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (2, "x" * 50), (3, None), (4, "d"), (None, "e")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (3, 0), (4, 0), (5, 0), (None, 1), (4, None)], "doc_id long, toxic int")
    got = labelled.labelled_sample(docs, labels, "toxic", F.lit(True), 10, longest=20)
    assert len(got) == 3 and {y for _, y in got} == {0, 1} and ("", 0) in got and ("d", 0) in got
    assert len(labelled.labelled_sample(docs, labels.where("doc_id < 5"), "toxic", F.lit(True), 1)) == 2
