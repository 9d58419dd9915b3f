"""Two passes, greedy corrections, languages of delimiters, regions and odd texts of the finer operators."""

import random

import pytest
from pyspark.sql import functions as F

from palimp.functions import regions, text, tokens
from palimp.operators import align, matching, sliders


def lines(spark, texts):
    return spark.createDataFrame([(p, i, v) for p, t in texts for i, v in enumerate(t.split("\n"))], "pair_id long, line_no int, line string")


def test_two_passes_give_the_rows_of_one(spark):
    rng = random.Random(8)
    pairs = [(0, "a\nb\nc", "c\nb\na"), (1, "dup\ndup\ndup", "dup\nX\ndup"), (2, "", ""), (3, "", "x\ny"), (4, "x\ny", ""), (5, "a\nX\nb", "a\nb")]
    pairs += [(10 + k, "\n".join(rng.choices("abcdefghijklmnop", k=rng.randint(1, 25))), "\n".join(rng.choices("abcdefghijklmnop", k=rng.randint(1, 25)))) for k in range(40)]
    one = align.line_edits(spark.createDataFrame(pairs, "pair_id long, old_text string, new_text string"))
    two = align.two_pass_edits(lines(spark, [(p, a) for p, a, _ in pairs]), lines(spark, [(p, b) for p, _, b in pairs]))
    cols = ["pair_id", "seq", "op", "old_no", "new_no", "line"]
    assert sorted(map(str, one.select(cols).collect())) == sorted(map(str, two.select(cols).collect()))


def test_patience_moves_take_the_first_of_equals(spark):
    rows = [(1, "-", 0, None, "same words here"), (1, "-", 1, None, "same words here"), (1, "+", None, 5, "same words here"), (1, "+", None, 4, "Same  words here"), (1, "+", None, 9, "unlike")]
    rest = spark.createDataFrame(rows, "pair_id long, op string, old_no int, new_no int, line string")
    assert sorted(map(tuple, matching.patience_moves(rest).collect())) == [(1, 0, 4, 1.0), (1, 1, 5, 1.0)]  # the same words are as similar as the same line


@pytest.mark.parametrize(
    "language,given,want",
    [("json", "( a ) [ 1,  2 ]", "(a)[1, 2]"), ("python", "f( x,   y )", "f(x, y)"), ("html", "<!--  a   b  -->", "<!-- a b -->"), ("javascript", "${ x }", "${x}"), (None, "[ ]", "[]"), ("css", "", "")],
)
def test_delimiters_by_language(spark, language, given, want):
    got = spark.createDataFrame([(given, language)], "t string, l string").select(text.normalize_delimiters("t", F.col("l")).alias("x"), text.normalize_with_state(F.col("t"), language)["original"].alias("o")).first()
    assert got["o"] == given and got["x"].replace(" ", "") == want.replace(" ", "") and text.normalize_delimiters_text(given, language) == got["x"]


def test_validation_by_language(spark):
    x = spark.createDataFrame([("a < b [", "json"), ("a < b [", "python"), (None, "css")], "t string, l string").select(F.size(text.validate_delimiters("t", F.col("l"))).alias("n"))
    assert [r["n"] for r in x.collect()] == [1, 2, 0]


@pytest.mark.parametrize("line", ["", 'x = "a" // b', "// all", '"s1" "s2"', "/* a */ b /* c", "plain"])
def test_regions_with_code(spark, line):
    found = regions.regions_of(line, "c")
    row = spark.createDataFrame([(line,)], "line string").withColumn("r", regions.regions("line", F.lit("c"))).select(regions.with_code(F.col("r"), F.col("line")).alias("w"), regions.without_comments(F.col("r"), F.col("line")).alias("n"), *(regions.region_type_at(F.col("r"), F.lit(i)).alias(f"at{i}") for i in range(len(line)))).first()
    assert "".join(r["content"] for r in row["w"]) == line and [r["start"] for r in row["w"]] == sorted(r["start"] for r in row["w"])
    assert row["n"] == "".join(r["content"] for r in row["w"] if r["type"] != "comment")
    for i in range(len(line)):
        assert row[f"at{i}"] == next((r["type"] for r in found if r["start"] <= i < r["end"]), "code")


def test_first_line_like(spark):
    x = spark.createDataFrame([(["one", " two words ", "two words more", ""], "two words"), (["abc def ghi jkl"], "def"), (["abc defg"], "defg"), ([], "x"), (["a" * 30], "a" * 35)], "l array<string>, t string")
    assert [r[0] for r in x.select(text.first_line_like(F.col("l"), F.col("t"))).collect()] == [1, -1, 0, -1, 0]


def test_corrections_need_two_modified_rows_and_room(spark):
    rows = spark.createDataFrame([(1, i, c, f"t{i} {{ x") for i, c in enumerate(["modified", "modified", "modified", "added", "modified", "unchanged"], 1)], "pair_id long, seq int, classification string, text string")
    s = spark.createDataFrame([(1, 2, 1, 0.9, 0.1, 0.5, 0.9), (1, 3, 2, 0.8, 0.1, 0.5, 0.0), (1, 5, 3, 0.8, 0.1, 0.9, 0.8)], "pair_id long, seq int, place int, confidence double, current_score double, left_score double, right_score double")
    got = {r["seq"]: (r["new_seq"], r["value"]) for r in sliders.correct_order(rows, s, 0.7, "java").collect()}
    assert {k: v[0] for k, v in got.items()} == {1: 1, 2: 3, 3: 2, 4: 4, 5: 5, 6: 6} and got[2][1] == "t2x {" and got[1][1] == "t1 { x"


def test_slider_statistics_of_none(spark):
    none = spark.createDataFrame([], "confidence double, recommendation string, language string")
    assert sliders.slider_statistics(none).first()["total"] == 0


def test_token_details():
    x = tokens.compare_tokens("const x = 5;", "const y = 5;")
    assert x["identifier"] == 0 and x["keyword"] == 1 and 0.7 < x["similarity"] < 1
