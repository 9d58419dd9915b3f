"""The language model against seat-by-seat sampling and sums over all words; very long and repeated texts; more texts than a chunk holds."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palimp.llm import pitman_yor as py
from palimp.llm.textkernel import tokenize


@pytest.mark.parametrize("c,x,d", [(6, 0.5, 0.5), (12, 3.0, 0.3), (30, 0.05, 0.8)])
def test_tables_as_seat_by_seat(c, x, d):
    rng = np.random.default_rng(0)
    tables, seats, seen = [1] * c, list(range(c)), []
    for _ in range(8000):
        for i in range(c):
            tables[seats[i]] -= 1
            free = tables.index(0)
            w = np.array([n - d if n else 0.0 for n in tables])
            w[free] = x
            seats[i] = int(np.searchsorted(np.cumsum(w), rng.random() * w.sum()))
            tables[seats[i]] += 1
        seen.append(sum(n > 0 for n in tables))
    got = py.sample_tables(np.full(40_000, c), np.full(40_000, x), py.log_stirling(np.array([c]), d), rng, d)
    assert abs(np.mean(seen[500:]) - got.mean()) < 0.05 and abs(np.std(seen[500:]) - got.std()) < 0.05


def test_many_tables_near_the_exact_row():
    """Beyond MANY tables the limit of many customers takes the row's place: some percent above it for few customers."""
    rng = np.random.default_rng(0)
    for c, x, d, most in ((5000, 100.0, 0.5, 0.12), (60_000, 100.0, 0.5, 0.04)):
        row = py.log_stirling(np.array([c]), d, 1000)[c]
        p = np.exp((q := row + np.arange(1, len(row) + 1) * np.log(x)) - q.max())
        exact = (p * np.arange(1, len(row) + 1)).sum() / p.sum()
        got = py.sample_tables(np.full(4000, c), np.full(4000, x), {}, rng, d).mean()
        assert 0 <= got / exact - 1 < most


def test_word_restaurants_add_up():
    rng = np.random.default_rng(3)
    parent = rng.dirichlet(np.ones(40))
    r = np.repeat(np.arange(25), 40)
    c = rng.integers(0, 9, 1000) * (rng.random(1000) < 0.3)
    p = py.word_restaurants(r, c, np.tile(parent, 25), rng)
    assert np.allclose(np.bincount(r, p), 1) and (p > 0).all()


def score(spark, train, texts):
    rows = [(0, t) for t in train] + [(i + 1, t) for i, t in enumerate(texts)]
    got = py.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") > 0).where("doc_id > 0").toPandas()
    return got.set_index("doc_id").sort_index()


def test_probabilities_of_all_words_add_up(spark, monkeypatch):
    """With few dishes, so that all kinds of restaurants occur: the probabilities of all words after each word, of those that begin a text, and of the empty text."""
    monkeypatch.setattr(py, "DISHES", py.CLASSES + 1 + 4)
    rng = random.Random(2)
    vocabulary = [f"{a}{b}" for a in ("ba", "de", "go", "xy") for b in ("st", "ny", "ter")]
    train = [" ".join(rng.choices(vocabulary, [2.0 ** -(i / 2) for i in range(12)], k=rng.randint(1, 30))) for _ in range(120)]
    classes = {}
    i = 0
    while len(classes) < py.CLASSES:  # an unknown word of each class
        w = f"q{i:x}"
        classes.setdefault(int(py.word_keys(tokenize(pa.array([w])))[0] & np.uint64(255)), w)
        i += 1
    words = vocabulary + sorted(classes.values())
    n = len(words)
    texts = ["", *words, *(f"{v} {words[0]}" for v in words), *(f"{u} {v} {words[0]}" for u in words for v in words)]
    s = 10.0 ** score(spark, train, texts)["score"].to_numpy()
    end, alone, pair, triple = s[0], s[1 : n + 1], s[n + 1 : 2 * n + 1], s[2 * n + 1 :].reshape(n, n)
    # triple / pair is P(u first) P(v after u) / P(v first); of all that may follow u the sum is 1, which gives P(u first)
    first = np.linalg.solve(np.eye(n) - triple / pair[None, :], alone)
    assert (first > 0).all() and abs(first.sum() + end - 1) < 1e-3


def test_repeated_context_is_learnt(spark, monkeypatch):
    """Words that are no dishes follow each other: a text that holds the pairs of the training is likelier than one with the same words in another order."""
    monkeypatch.setattr(py, "DISHES", py.CLASSES + 1 + 5)
    rng = random.Random(4)
    words = [f"word{rng.random()}" for _ in range(300)]
    train = [" ".join(words) + " end" * 20] * 3 + [" ".join(rng.sample(words, 50)) for _ in range(10)]
    other = words[:]
    rng.shuffle(other)
    got = score(spark, train, [" ".join(words), " ".join(other)])
    assert got["score"][1] > got["score"][2] + 100 and got["perplexity"][1] < got["perplexity"][2]
    assert np.allclose(got["perplexity"], 10 ** (-got["score"] / got["n_tokens"]))


def test_many_texts_and_repeats(spark, monkeypatch):
    """More texts than a chunk holds, a word repeated beyond 65,535 times, and few tokens a chunk: scores are those of one chunk."""
    texts = ["again " * 70_000, "a b c d", "", None] + [f"w{i % 7} x{i % 5}" for i in range(3000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    one = py.score_texts(rows, F.lit(False)).orderBy("doc_id").toPandas()
    monkeypatch.setattr(py, "PACK_TEXTS", 500)
    monkeypatch.setattr(py, "PACK", 2000)
    many = py.score_texts(rows, F.lit(False)).orderBy("doc_id").toPandas()
    assert np.allclose(one["score"], many["score"], rtol=1e-3) and (one["n_tokens"] == many["n_tokens"]).all() and one["n_tokens"][0] == 70_001


def test_words_beyond_the_broadcast_have_their_own_probability(spark, monkeypatch):
    """Scores with few broadcast counts are those with all of them: a word beyond has the probability of its own count, not the mean of such words."""
    monkeypatch.setattr(py, "DISHES", py.CLASSES + 1 + 4)
    rng = random.Random(9)
    words = [f"w{i}xyz" for i in range(60)]  # one class
    train = [" ".join(rng.choices(words, [1 / (i + 1) for i in range(60)], k=40)) for _ in range(30)]
    texts = [w for w in words] + [f"{a} {b}" for a, b in zip(words, words[7:], strict=False)] + ["unheardxyz"]
    whole = score(spark, train, texts)
    monkeypatch.setattr(py, "KNOWN", 12)
    cut = score(spark, train, texts)
    assert np.allclose(whole["score"], cut["score"], atol=1e-4) and np.allclose(whole["base_score"], cut["base_score"]) and (whole["n_known"] == cut["n_known"]).all()
    assert len({round(x, 2) for x in cut["score"][:60]}) > 5


def test_pieces_are_compact(monkeypatch):
    """What goes through the shuffle to the restaurants, compressed as Spark does, has less than 8 bytes for each token that is a rare word or comes after one."""

    class Task:
        get = staticmethod(lambda: Task)
        partitionId = staticmethod(lambda: 0)

    monkeypatch.setattr(py, "TaskContext", Task)
    rng = np.random.default_rng(5)
    texts = pa.array([" ".join(f"w{x}" for x in (60_000 * rng.random(300) ** 3).astype(int)) for _ in range(600)])
    keys, count = np.unique(py.word_keys(tokenize(texts)), return_counts=True)
    v = py.Vocabulary(keys[count > 1], count[count > 1], int(np.sort(count)[-200]))
    class_key = np.unique((keys & np.uint64(255)).astype(np.int64) << 48 | py.binned(count))
    log_p = np.log10(rng.dirichlet(np.ones(v.dishes), v.dishes)).astype(np.float32)
    model = type("Model", (), {"value": (v, log_p, class_key, np.log10(rng.random(len(class_key))), int(count.sum()), len(keys), 600)})
    rows = pa.RecordBatch.from_arrays([pa.array(range(600)), texts, pa.array([i % 5 == 1 for i in range(600)])], names=["doc_id", "text", "held_out"])
    pieces = [b.column(3)[0].as_py() for b in py._pack(model, 4)(iter([rows])) if b.column(2)[0].as_py() == 1]
    h, off = py.with_ends(tokenize(texts))
    rare = v.find(h)[0] > v.own
    deep = rare | np.r_[False, rare[:-1]] & ~np.isin(np.arange(len(h)), off[:-1])
    assert len(pieces) == 4 and sum(len(pa.compress(x, "lz4_raw", asbytes=True)) for x in pieces) < 8 * deep.sum()
