"""Scalar functions on small examples."""

import pytest
from pyspark.sql import functions as F

from palimp.functions import edit, language, regions, signature, similarity, syntax, text, tokens


def one(spark, expr, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(expr.alias("r")).first()["r"]


@pytest.mark.parametrize("a,b,low,high", [("abc", "xyz", 0, 0), ("  test  ", "test", 1, 1), ("interface GigabitEthernet0/1", "interface GigabitEthernet0/2", 0.5, 0.999), ("", "x", 0, 0), ("", "", 1, 1)])
def test_word_similarity(a, b, low, high):
    assert low <= edit.word_similarity_of(a, b) <= high


def test_scripts_reconstruct():
    import random

    random.seed(5)
    for _ in range(300):
        a, b = ([random.choice("abcd") for _ in range(random.randint(0, 12))] for _ in range(2))
        s = edit.script_of(a, b)
        assert [a[i] for o, i, _ in s if o != "+"] == a and [b[j] for o, _, j in s if o != "-"] == b
        assert all(a[i] == b[j] for o, i, j in s if o == "=")


def test_shortest_script_is_shortest():
    import random

    random.seed(6)
    for _ in range(200):
        a, b = ([random.choice("abc") for _ in range(random.randint(0, 9))] for _ in range(2))
        assert len(edit.shortest_matches(a, b)) == tokens.lcs_length(a, b)


def test_longest_increasing():
    assert edit.longest_increasing([]) == [] and len(edit.longest_increasing([3, 1, 2, 5, 4, 6])) == 4


def test_signature(spark):
    assert one(spark, signature.line_signature(F.col("a")), a="") == 0
    assert one(spark, signature.line_signature(F.col("a")) == signature.line_signature(F.lower("a")), a="Interface")
    assert one(spark, signature.content_hash(F.col("a")), a="   ") == "0" * 32
    assert one(spark, signature.djb2(F.col("a")), a="") == 0 and one(spark, signature.djb2(F.col("a")), a="a") == 5381 * 33 + 97


def test_fast_similarity(spark):
    f = similarity.fast_line_similarity(F.col("a"), F.col("b"))
    assert one(spark, f, a="", b="x") == 0 and one(spark, f, a=" A ", b="a") == 1
    assert one(spark, f, a="abcd", b="abxx") == pytest.approx(0.5001)


def test_delimiters():
    assert text.normalize_delimiters_text("[ x ]") == "[x]" and text.normalize_delimiters_text("[ ]") == "[]"
    assert text.delimiter_errors("(a[b]c)") == [] and [e["type"] for e in text.delimiter_errors("(]")] == ["unexpected_close", "unclosed"]
    assert text.strip_comments_text("a // b\nc # d\n'#' e\nx /* y */ z") == "a \nc \n'#' e\nx  z"


def test_tokens():
    assert [k for k, _ in tokens.tokenize_line("const x = 5; // c")] == ["keyword", "identifier", "operator", "number", "delimiter", "comment"]
    assert tokens.compare_tokens("const x = 5;", "const y = 5;")["similarity"] > 0.7
    assert tokens.compare_tokens("", "")["similarity"] == 1.0


def test_regions():
    assert [(r["type"], r["start"]) for r in regions.regions_of("const x = 5; // This is a comment", "javascript")] == [("comment", 13)]
    assert [r["content"] for r in regions.regions_of('print("Hello") # Python comment', "python")] == ['"Hello"', "# Python comment"]
    assert len(regions.regions_of("/* a */ x /* b */", "c")) == 2
    assert regions.regions_of(r'"a\"b\"c" x', "c")[0]["end"] == 9
    assert regions.nested_changes("x; // old comment", "x; // new comment", "c")[0]["type"] == "comment"


@pytest.mark.parametrize("name,content,expected", [("a.PY", "", "python"), ("x.d.ts", "hello", None), (None, '{"a": 1}', "json"), (None, "def f(x):\n    print(x)\n# c", "python"), (None, "const a = 1;\nconsole.log(a) => 2", "javascript"), (None, "plain words", None)])
def test_language(spark, name, content, expected):
    assert one(spark, language.detect_language(F.col("a"), F.col("b")), a=name, b=content) == expected


def test_file_type(spark):
    f = language.file_type(F.col("a"))
    assert one(spark, f, a="hostname r1\n!") == "cisco-ios" and one(spark, f, a="<a>b</a>") == "xml" and one(spark, f, a="words") == "text"


def test_trees():
    assert syntax.tree_similarity("x = 1", "y = 2") == 1.0 and syntax.tree_similarity("x =", "y") is None and syntax.tree_similarity("f(x)", "import os") < 1


def test_mixed_similarity_at_a_half():
    """A sum of weights one bit below that of sum(), which SQL has too: 0.7 of it and 0.3 of the words' similarity lie below a half of the sixth digit."""
    from palimp.functions.edit import word_similarity_of
    from palimp.functions.tokens import compare_tokens

    a, b = "The bleennt eredtiwh esnden blest onoren thiningtion, shnding enou theden onndanha.", "Thheouble heenwh on reti ingeser erster that."
    c = compare_tokens(a, b)
    assert c["similarity"] == 0.55 * c["normalized"] + 0.25 * c["keyword"] + 0.15 * c["identifier"] + 0.05 * c["raw"]
    assert 0.7 * c["similarity"] + 0.3 * word_similarity_of(a, b) < 0.2478125


def test_tokens_of_texts_in_pieces(spark, monkeypatch):
    """Texts whose tokens are many are handed back in pieces, with the tokens that one piece gives; null stays null."""
    from palimp.functions import tokens as tok

    monkeypatch.setattr(tok, "HELD", 50)
    texts = ["x = 1; y" * n for n in range(20)] + [None, "", "a" * 500]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    pieces = tok.tokens_of_texts(rows, "doc_id", "text")
    got = {r["doc_id"]: r["tokens"] for r in pieces.collect()}
    assert all((got[i] is None) if t is None else [tuple(x) for x in got[i]] == tok.tokenize_line(t, True) for i, t in enumerate(texts))
