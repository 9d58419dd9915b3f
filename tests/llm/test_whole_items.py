"""Near copies of benchmark items without an answer: every one that holds 0.8 of the item's shingles is found."""

import random

import pyarrow as pa

from palimp.llm import decontaminate


def shingles(w):
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_one_word_replaced():
    rng = random.Random(6)
    items = [[rng.choice("abcdefgh") + str(rng.randint(0, 40)) for _ in range(n)] for n in (15, 24, 38, 59, 130)]
    texts, of = [], []
    for i, w in enumerate(items):
        for k in range(len(w)):
            v = [*w[:k], "replaced", *w[k + 1 :]]
            if len(shingles(w) & shingles(v)) >= 0.8 * len(shingles(w)):
                texts.append(" ".join(["before"] * rng.randint(0, 100) + v + ["after"] * rng.randint(0, 100)))
                of.append(i)
    ix = decontaminate.build_indexes([(" ".join(w), None) for w in items], 5)
    got = {(d, i) for d, i, *_ in decontaminate.leaks(pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"]), ix, 0.8)}
    assert len(texts) > 200 and got == set(enumerate(of))
    half = [" ".join(w[: len(w) // 2]) for w in items]
    assert not decontaminate.leaks(pa.RecordBatch.from_arrays([pa.array(half)], names=["text"]), ix, 0.8)


def test_answer_is_verified_apart():
    q, a = [f"q{i}" for i in range(30)], [f"a{i}" for i in range(10)]
    ix = decontaminate.build_indexes([(" ".join(q), " ".join(a))], 5)
    texts = [" ".join(q + a), " ".join(q + a[:5] + ["other"] * 5)]
    assert [x[0] for x in decontaminate.leaks(pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"]), ix, 0.8)] == [0]
