"""Diagonal runs against all combinations, with lines repeated more than a hundred times on both sides."""

from palimp.operators.align import diagonal_runs
from palimp.operators.matching import block_moves


def brute(a, b):
    cells = {(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x == y}
    out = []
    for i, j in cells:
        if (i - 1, j - 1) not in cells:
            n = 1
            while (i + n, j + n) in cells:
                n += 1
            out.append((i, j, n))
    return sorted(out)


def frame(spark, texts):
    return spark.createDataFrame([(k, i, x) for k, t in texts.items() for i, x in enumerate(t)], "pair_id long, line_no int, line string")


def test_repeated_lines(spark):
    old = {1: ["}"] * 110, 2: ["a", "}", "b"] * 110, 3: ["x", "}", "}", "y", "z"] + ["}"] * 105, 4: ["only old"]}
    new = {1: ["}"] * 120, 2: ["}", "a", "}", "c"] * 105, 3: ["}"] * 103 + ["x", "}", "}", "y"], 4: ["only new"]}
    got = {k: [] for k in old}
    for r in diagonal_runs(frame(spark, old), frame(spark, new)).collect():
        got[r["pair_id"]].append((r["start_old"], r["start_new"], r["size"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: brute(old[k], new[k]) for k in old}


def test_moved_block_with_repeated_lines(spark):
    """110 equal lines inside a block make 12,100 combinations; the block stays one."""
    block = ["head", *["}"] * 110, "tail"]
    rows = [(1, "-", i, None, x) for i, x in enumerate(block)] + [(1, "+", None, 500 + i, x) for i, x in enumerate(block)]
    got = block_moves(spark.createDataFrame(rows, "pair_id long, op string, old_no int, new_no int, line string")).collect()
    assert sorted((r["start_old"], r["start_new"], r["size"]) for r in got) == [(0, 500, 100), (100, 600, 12)]
