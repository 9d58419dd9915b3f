"""Connected components of chains, stars with a hub of many links, and random links, against union-find."""

import random

import pytest

from palimp.llm import components


@pytest.mark.parametrize("many,hot", [(5_000_000, 0.001), (0, 0.001), (0, 0.1)])
def test_components(spark, monkeypatch, many, hot):
    monkeypatch.setattr(components, "MANY", many)
    monkeypatch.setattr(components, "HOT", hot)
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(40)] + [(1000, 1001 + i) for i in range(400)] + [(5000 + i, 4999) for i in range(200)] + [(rng.randint(10_000, 10_300), rng.randint(10_000, 10_300)) for _ in range(200)] + [(7, 7), (None, 3), (1200, 5100)]
    lead = {}

    def find(x):
        while lead.setdefault(x, x) != x:
            x = lead[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            lead[b] = a
    got = components.connected_components(spark.createDataFrame(links * 2, "a long, b long"), "a", "b").collect()
    assert {r["node"]: r["root"] for r in got} == {x: find(x) for x in lead if x != 7 or find(7) != 7} and len(got) == len({r["node"] for r in got})
    assert components.connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0
