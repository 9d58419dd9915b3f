"""Documents that share lines, against brute force; groups of copies and lines of many documents included."""

import random

import pytest

from palimp.sources.pairs import near_copy_pairs


def brute(rows, shared, hot):
    n = {k: len(t.split("\n")) for k, t in rows}
    s = {k: {x for x in t.split("\n") if len(x) > 20} for k, t in rows}
    docs = {}
    for x in s.values():
        for line in x:
            docs[line] = docs.get(line, 0) + 1
    s = {k: {x for x in v if hot is None or docs[x] <= hot} for k, v in s.items()}
    return sorted((a, b, len(s[a] & s[b])) for a in s for b in s if a < b and s[a] & s[b] and len(s[a] & s[b]) / max(n[a], n[b]) >= shared)


@pytest.mark.parametrize("shared", [0.3, 0.6])
@pytest.mark.parametrize("hot", [None, 50])
def test_near_copies(spark, shared, hot):
    rng = random.Random(5)
    line = [f"a line that is long enough {i}" for i in range(30)]
    rows = [(i, "\n".join(rng.choices([*line, "short", "x"], [1 / (k + 1) for k in range(32)], k=rng.randint(1, 8)))) for i in range(150)]
    rows += [(1000 + i, "a copy in a group above fifty\nwith another line of its own") for i in range(60)]
    got = near_copy_pairs(spark.createDataFrame(rows, "doc_id long, text string"), shared, hot=hot).collect()
    want = brute(rows, shared, hot)
    assert sorted((r["a_id"], r["b_id"], r["common"]) for r in got) == want
    assert sum(a >= 1000 for a, _, _ in want) == (60 * 59 // 2 if hot is None else 0)
