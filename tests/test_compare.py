"""Invariants of the full comparison, and the driver's contract."""

import pytest
from pyspark.sql import functions as F

from palimp.config import Options
from palimp.plans.compare import compare, stats

CASES = [
    (1, "a\nb\nc", "c\nb\na"), (2, "dup\ndup\ndup", "dup\nX\ndup"), (3, "\n\n", "\n"), (4, "line one", "line one\nnew line added"), (5, "line one\nnew line added", "line one"), (6, "same", "same"), (7, "", "x"),
    (8, "def process_data(data):\n  pass", "x = 1\ndef process_data(data, factor=1.5):\n  pass"), (9, "\n".join(f"old {i}" for i in range(40)), "\n".join(f"new {i}" for i in range(40))), (10, "é 😀\tx\r", "é 😀 y"),
    (11, "one two three\nfour five six\nalpha\nbeta gamma\ndelta", "alpha\nbeta gamma\ndelta\none two three\nfour five six"), (12, None, "a"),
]


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame(CASES, "pair_id long, old_text string, new_text string")


@pytest.mark.parametrize("options", [Options(), Options(max_pairs=1), Options(detect_moves=False)])
def test_content_is_kept(pairs, options):
    rows = compare(pairs, options).collect()
    for k, a, b in CASES:
        old = sorted((r["old_no"], r["removed_line"]) for r in rows if r["pair_id"] == k and r["old_no"] is not None)
        new = sorted((r["new_no"], r["added_line"]) for r in rows if r["pair_id"] == k and r["new_no"] is not None)
        assert [x for _, x in old] == (a or "").split("\n") and [x for _, x in new] == (b or "").split("\n")
        assert [i for i, _ in old] == list(range(len(old))) and [i for i, _ in new] == list(range(len(new)))


def test_classes(pairs):
    s = {r["pair_id"]: r for r in stats(compare(pairs)).collect()}
    assert (s[4]["added"], s[4]["removed"], s[4]["unchanged"]) == (1, 0, 1) and (s[5]["removed"], s[5]["added"]) == (1, 0)
    assert s[6]["unchanged"] == s[6]["total_changes"] == 1
    assert s[11]["moved"] >= 2 and s[8]["modified"] + s[8]["moved"] >= 1


def test_stream(spark, pairs, tmp_path):
    from palimp.streaming.compare_stream import compare_stream

    pairs.write.parquet(str(tmp_path / "in"))
    q = compare_stream(spark.readStream.schema(pairs.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(CASES)


def test_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["line_explode", "line_signature", "unique_anchors", "hash_block_runs", "changed_regions", "exact_line_moves", "unified_patch", "fast_line_similarity"])
def test_against_sql(spark, name):
    import duckdb

    from palimp.plans import registry

    d = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    got = registry.QUERIES[name](spark, d)
    cols = sorted(got.columns)
    want = c.execute(f"SELECT {', '.join(cols)} FROM ({registry.ORACLES[name]})").fetchall()
    assert sorted(map(str, map(tuple, got.select(*cols).collect()))) == sorted(map(str, want))
