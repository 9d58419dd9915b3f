"""Similarity of two lines or texts: native expressions where the measure allows, an Arrow UDF for edit scripts of words."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .edit import word_similarities
from .text import bound, lines_of, normal_form, trimmed

#: Keywords that the quick measure looks for, and its weights.
QUICK_KEYWORDS = ("function", "const", "let", "var", "if", "else", "for", "while", "return", "import", "export", "class", "async", "await")
KEYWORD_WEIGHT, DELIMITER_WEIGHT, BASE = 0.5, 0.3, 0.2
SHORT, EPSILON = 50, 0.0001


def _bag(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def _both(a: Column, b: Column, f) -> Column:
    """f of a struct of both normal forms and their words, computed once; null if one is null."""
    forms = F.struct(normal_form(a).alias("x"), normal_form(b).alias("y"))
    words = lambda t: F.struct(t["x"].alias("x"), t["y"].alias("y"), _bag(t["x"]).alias("wx"), _bag(t["y"]).alias("wy"))
    return F.when(a.isNotNull() & b.isNotNull(), bound(forms, lambda t: bound(words(t), f)))


def fast_line_similarity(a: Column, b: Column) -> Column:
    """Equal normal forms 1, one empty 0; below 50 characters the share of equal positions, else the words of b that a has, twice over both counts."""

    def score(t: Column) -> Column:
        x, y = t["x"], t["y"]
        la, lb = F.length(x), F.length(y)
        places = F.sequence(F.lit(1), F.greatest(F.least(la, lb), F.lit(1)))
        same = F.size(F.filter(places, lambda i: x.substr(i, F.lit(1)) == y.substr(i, F.lit(1))))
        common = F.size(F.filter(t["wy"], lambda w: F.array_contains(t["wx"], w)))
        value = F.when(F.greatest(la, lb) < SHORT, same / F.greatest(la, lb)).otherwise(2 * common / F.greatest(F.size(t["wx"]) + F.size(t["wy"]), F.lit(1)))
        return F.when(x == y, 1.0).when((la == 0) | (lb == 0), 0.0).otherwise(F.least(value + EPSILON, F.lit(1.0)))

    return _both(a, b, score)


def patience_similarity(a: Column, b: Column) -> Column:
    """Equal 1, equal normal forms 0.95, else shared words."""

    def score(t: Column) -> Column:
        common = F.size(F.filter(t["wy"], lambda w: F.array_contains(t["wx"], w)))
        none = (F.size(t["wx"]) == 0) | (F.size(t["wy"]) == 0)
        return F.when(t["x"] == t["y"], 0.95).when(none, 0.0).otherwise(2 * common / (F.size(t["wx"]) + F.size(t["wy"])))

    return F.when(a == b, 1.0).otherwise(_both(a, b, score))


def quick_token_similarity(a: Column, b: Column) -> Column:
    """Shared keywords (found as substrings), numbers of delimiters, and a base."""
    kw = F.array(*(F.lit(k) for k in QUICK_KEYWORDS))
    forms = F.struct(*(F.regexp_replace(normal_form(c), r"\s+", " ").alias(n) for c, n in ((a, "x"), (b, "y"))))

    def score(t: Column) -> Column:
        x, y = t["x"], t["y"]
        ka, kb = F.filter(kw, lambda k: F.contains(x, k)), F.filter(kw, lambda k: F.contains(y, k))
        da, db = (F.length(F.regexp_replace(c, r"[^(){}\[\];,]", "")) for c in (x, y))
        shared = F.when(F.size(ka) + F.size(kb) > 0, 2 * F.size(F.array_intersect(ka, kb)) / (F.size(ka) + F.size(kb))).otherwise(1.0)
        delimiters = 1 - F.abs(da - db) / F.greatest(da, db, F.lit(1))
        return F.when(x == y, 1.0).when((x == "") | (y == ""), 0.0).otherwise(shared * KEYWORD_WEIGHT + delimiters * DELIMITER_WEIGHT + BASE)

    return F.when(a.isNotNull() & b.isNotNull(), bound(forms, score))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; both empty 1."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def word_set(c: Column) -> Column:
    return F.array_distinct(_bag(normal_form(c)))


def block_similarity(a: Column, b: Column) -> Column:
    """Trimmed non-blank lines in common, as a multiset, over the larger number of them."""
    x, y = (F.filter(F.transform(lines_of(c), trimmed), lambda v: v != "") for c in (a, b))
    keys = F.array_intersect(x, y)
    times = lambda arr, v: F.size(F.filter(arr, lambda z: z == v))
    common = F.aggregate(keys, F.lit(0), lambda s, v: s + F.least(times(x, v), times(y, v)))
    most = F.greatest(F.size(x), F.size(y))
    return F.when(most == 0, 0.0).otherwise(common / most)


@F.arrow_udf(T.DoubleType())
def word_similarity(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array(word_similarities(a.to_pylist(), b.to_pylist()), pa.float64())
