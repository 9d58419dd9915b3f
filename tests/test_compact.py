"""The comparison of pairs in their tasks gives the rows of the comparison by tables of lines."""

import random

import pytest
from pyspark.sql import functions as F

from palimp.config import Options
from palimp.operators.align import line_edits
from palimp.operators.compact import compare_pairs
from palimp.plans.compare import classify, classify_fast, compare

COLS = ["pair_id", "seq", "classification", "old_no", "new_no", "removed_line", "added_line", "round(similarity, 9) AS s"]
WORDS = ["alpha", "Beta", "gamma delta", "return x;", "if (a > b)", "", "  ", "ÄÖ ü", "word " * 12, "one two three four five six seven eight nine ten eleven"]


def pairs(spark, n=60):
    rng = random.Random(21)
    line = lambda: rng.choice(WORDS) + rng.choice(["", "", " x", " 1", "  y z", "\t"])
    rows = [(-1, None, None), (-2, "", "a\nb"), (-3, "a\nb\nc", ""), (-4, "same\nlines", "same\nlines"), (-5, "x\n" * 40, "y\n" + "x\n" * 35)]
    for k in range(n):
        old = [line() for _ in range(rng.randint(1, 30))]
        new = [v for v in old if rng.random() > 0.2]
        for _ in range(rng.randint(0, 6)):
            new.insert(rng.randint(0, len(new)), line())
        i = rng.randint(0, len(new))
        new = new[i:] + new[:i] if rng.random() < 0.5 else new
        new = [v + " changed" if rng.random() < 0.15 else v for v in new]
        rows.append((k, "\n".join(old), "\n".join(new)))
    return spark.createDataFrame(rows, "pair_id long, old_text string, new_text string")


@pytest.mark.parametrize("options", [Options(), Options(detect_moves=False), Options(modified_threshold=0.3, move_threshold=0.6), Options(use_tokens=True), Options(language="python"), Options(max_block=3, max_blocks=2)], ids=lambda o: str(o)[8:60])
def test_same_rows(spark, options):
    p = pairs(spark)
    one = compare_pairs(p, options).selectExpr(*COLS)
    two = classify(line_edits(p), options).selectExpr(*COLS)
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))


def test_degraded_mode(spark):
    p = pairs(spark)
    one = compare_pairs(p, Options(max_pairs=-1)).selectExpr(*COLS)
    two = classify_fast(line_edits(p)).selectExpr(*COLS)
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))


def test_empty_table_and_names(spark):
    p = pairs(spark, 2).withColumn("seq", F.lit("clash"))
    assert compare_pairs(p.limit(0), Options()).count() == 0 and compare_pairs(p, Options()).columns[1] == "seq"


def test_without_degraded_mode_and_with_two_passes(spark):
    p = pairs(spark)
    one = compare(p, Options()).selectExpr(*COLS)
    two = compare(p, Options(fast_mode=False, two_pass_threshold=20)).selectExpr(*COLS)
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))


def test_late_moves_change_removed_and_added_rows(spark):
    old = "def f():\n    return 1\n\nlong enough line one\nkeep\nkeep too"
    new = "keep\nkeep too\nnew line that is long\ndef f():\n    return 1\n"
    p = spark.createDataFrame([(1, old, new)], "pair_id long, old_text string, new_text string")
    late = {r["classification"] for r in compare(p, Options(detect_moves=False, modified_threshold=2.0, late_moves=True)).collect()}
    assert "moved" in late and "moved" not in {r["classification"] for r in compare(p, Options(detect_moves=False, modified_threshold=2.0)).collect()}


def test_trees_only_up_to_a_number_of_lines(spark):
    p = spark.createDataFrame([(1, "x = f(1)", "y = g(2)")], "pair_id long, old_text string, new_text string")
    sim = lambda **o: [r["similarity"] for r in compare(p, Options(language="python", modified_threshold=0.1, **o)).where("classification = 'modified'").collect()]
    assert sim() != sim(max_lines_for_ast=1)
