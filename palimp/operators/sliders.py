"""Ambiguous change boundaries: scores of a row and its neighbours by window frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimp.functions.text import trimmed

AMBIGUITY, MOST, CORRECTION, FRAME, LARGEST = 0.15, 50, 0.7, 5, 10_000
#: Weights (brace, indent, comment, delimiter) by language.
WEIGHTS = {"javascript": (0.3, 0.2, 0.2, 0.3), "typescript": (0.3, 0.2, 0.2, 0.3), "java": (0.25, 0.25, 0.2, 0.3), "c": (0.25, 0.25, 0.2, 0.3), "cpp": (0.25, 0.25, 0.2, 0.3), "python": (0.0, 0.5, 0.3, 0.2), "json": (0.4, 0.3, 0.1, 0.2), "yaml": (0.0, 0.6, 0.2, 0.2)}
OTHER = (0.25, 0.25, 0.25, 0.25)
#: Scores of delimiters that are there on both sides or on one; of no evidence; of an indent that the neighbour has, or hasn't; of a comment next to one or alone, of a line between comments or of any other; of an
#: opening brace after a signature or elsewhere, and of a closing one.
BOTH, ONE, NEUTRAL = 0.8, 0.3, 0.5
SAME_INDENT, OTHER_INDENT = 0.9, 0.4
NEAR_COMMENT, LONE_COMMENT, BETWEEN_COMMENTS, NO_COMMENT = 0.9, 0.5, 0.2, 0.8
AFTER_SIGNATURE, ELSEWHERE, CLOSING = 0.9, 0.4, 0.7
#: What begins a comment, what looks like a signature, and the languages whose opening braces end a line.
COMMENT, SIGNATURE = r"^(//|#|/\*|\*|<!--|--)", r"\b(function\s+\w+|class\s+\w+|if\s*\(|for\s*\(|while\s*\(|else\s*if)|\)\s*$"
BRACES = ("javascript", "typescript", "java", "c", "cpp", "csharp")


def indent(c: Column) -> Column:
    """Leading white space, a tab as four."""
    return F.length(F.replace(F.regexp_extract(c, r"^(\s*)", 1), F.lit("\t"), F.lit("    ")))


def _holds(mark: str, center: Column, around: Column) -> Column:
    return F.contains(center, F.lit(mark)) | F.exists(around, lambda v: F.contains(v, F.lit(mark)))


def delimiter_score(center: Column, before: Column, after: Column) -> Column:
    total, checks = F.lit(0.0), F.lit(0)
    for a, b in ("()", "[]", "{}"):
        x, y = _holds(a, center, before), _holds(b, center, after)
        total = total + F.when(x & y, BOTH).when(x | y, ONE).otherwise(0.0)
        checks = checks + F.when(x | y, 1).otherwise(0)
    return F.when(checks > 0, total / checks).otherwise(NEUTRAL)


def indent_score(center: Column, before: Column, after: Column) -> Column:
    mean = lambda arr: F.aggregate(arr, F.lit(0.0), lambda s, v: s + indent(v)) / F.size(arr)
    i, nb, na = indent(center), F.size(before), F.size(after)
    x = F.when(nb > 0, F.when(i == indent(F.element_at(before, -1)), SAME_INDENT).otherwise(OTHER_INDENT)).otherwise(0.0)
    y = F.when(na > 0, F.when(i == indent(F.element_at(after, 1)), SAME_INDENT).otherwise(OTHER_INDENT)).otherwise(0.0)
    z = F.when((nb > 0) & (na > 0), 0.5 * (1 - F.abs(i - (mean(before) + mean(after)) / 2))).otherwise(0.0)
    checks = F.when(nb > 0, 1).otherwise(0) + F.when(na > 0, 1).otherwise(0) + F.when((nb > 0) & (na > 0), 1).otherwise(0)
    return F.when(checks > 0, (x + y + z) / checks).otherwise(NEUTRAL)


def comment_score(center: Column, before: Column, after: Column) -> Column:
    is_comment = lambda v: trimmed(v).rlike(COMMENT)
    b, a = F.exists(before, is_comment), F.exists(after, is_comment)
    return F.when(is_comment(center), F.when(a | b, NEAR_COMMENT).otherwise(LONE_COMMENT)).otherwise(F.when(a & b, BETWEEN_COMMENTS).otherwise(NO_COMMENT))


def brace_score(center: Column, before: Column) -> Column:
    x, y = F.contains(center, F.lit("{")), F.contains(center, F.lit("}"))
    last = F.when(F.size(before) > 0, F.element_at(before, -1)).otherwise("")
    return F.when(x | y, F.when(x, F.when(last.rlike(SIGNATURE), AFTER_SIGNATURE).otherwise(ELSEWHERE)).otherwise(0.0) + F.when(y, CLOSING).otherwise(0.0)).otherwise(NEUTRAL)


def contexts(rows: DataFrame, key: str = "pair_id", order: str = "seq", text: str = "text") -> DataFrame:
    """With before and after: up to FRAME texts on each side."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("before", F.collect_list(text).over(w.rowsBetween(-FRAME, -1))).withColumn("after", F.collect_list(text).over(w.rowsBetween(1, FRAME)))


def scores(rows: DataFrame, language: str | None = None, key: str = "pair_id", order: str = "seq", text: str = "text") -> DataFrame:
    """rows with current_score, left_score and right_score; beyond an end 0."""
    brace, ind, com, deli = WEIGHTS.get(language or "", OTHER)
    c = contexts(rows, key, order, text)
    t, b, a = F.col(text), F.col("before"), F.col("after")
    total = 0.5 + delimiter_score(t, b, a) * deli + indent_score(t, b, a) * ind + comment_score(t, b, a) * com + (brace_score(t, b) * brace if brace else 0.0)
    c = c.withColumn("current_score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))
    w = Window.partitionBy(key).orderBy(order)
    return c.withColumn("left_score", F.coalesce(F.lag("current_score").over(w), F.lit(0.0))).withColumn("right_score", F.coalesce(F.lead("current_score").over(w), F.lit(0.0))).drop("before", "after")


def sliders(rows: DataFrame, language: str | None = None) -> DataFrame:
    """Ambiguous modified rows: pair_id, seq, ambiguity, scores, recommendation, confidence, language, place (by confidence, then ambiguity, the highest first, then seq); the first MOST of a pair, none of a pair with more than
    LARGEST rows. rows: pair_id, seq, classification, text."""
    s = scores(rows, language).withColumn("rows", F.count("*").over(Window.partitionBy("pair_id"))).where(F.col("rows") <= LARGEST).where("classification = 'modified'")
    cur, left, right = F.col("current_score"), F.col("left_score"), F.col("right_score")
    gap = F.abs(cur - F.greatest(left, right))
    to_left, to_right = (left > right) & (left - cur > 0.1), (right > left) & (right - cur > 0.1)
    s = s.where(gap <= AMBIGUITY).withColumn("n", F.row_number().over(Window.partitionBy("pair_id").orderBy("seq"))).where(F.col("n") <= MOST)
    s = s.select("pair_id", "seq", (1 - gap / AMBIGUITY).alias("ambiguity"), "current_score", "left_score", "right_score", F.when(to_left, "shift_left").when(to_right, "shift_right").otherwise("keep").alias("recommendation"), F.when(to_left, F.least((left - cur) * 2, F.lit(1.0))).when(to_right, F.least((right - cur) * 2, F.lit(1.0))).otherwise(0.0).alias("confidence"), F.lit(language).cast("string").alias("language"))
    order = Window.partitionBy("pair_id").orderBy(F.round("confidence", 9).desc(), F.round("ambiguity", 9).desc(), "seq")
    return s.withColumn("place", F.row_number().over(order))


def slider_statistics(s: DataFrame) -> DataFrame:
    """One row: total, numbers by bands of confidence and by recommendation, and a map of numbers by language."""
    c = F.col("confidence")
    parts = (F.count("*").alias("n"), F.count_if(c >= 0.8).alias("high"), F.count_if((c >= 0.5) & (c < 0.8)).alias("medium"), F.count_if(c < 0.5).alias("low"), *(F.count_if(F.col("recommendation") == r).alias(r) for r in ("keep", "shift_left", "shift_right")))
    by = s.groupBy(F.coalesce("language", F.lit("unknown")).alias("language")).agg(*parts)
    total = [F.coalesce(F.sum(c), F.lit(0)).alias("total" if c == "n" else c) for c in ("n", "high", "medium", "low", "keep", "shift_left", "shift_right")]
    return by.agg(*total, F.map_from_entries(F.array_sort(F.collect_list(F.struct("language", "n")))).alias("languages"))


def adjust_boundaries(c: Column, language: str | None) -> Column:
    """In languages with braces, an opening brace that nothing closes goes to the end of its line; other lines stay."""
    if language not in BRACES:
        return c
    moves = F.contains(c, F.lit("{")) & ~F.contains(c, F.lit("}")) & ~trimmed(c).endswith("{")
    first = F.concat(F.regexp_extract(c, r"^([^{]*?)\s*\{", 1), F.regexp_extract(c, r"^[^{]*\{\s*([\s\S]*)$", 1))
    return F.when(moves, F.concat(trimmed(first), F.lit(" {"))).otherwise(c)


def correct_order(rows: DataFrame, s: DataFrame, threshold: float = CORRECTION, language: str | None = None) -> DataFrame:
    """rows with new_seq and value: neighbours swap places where a slider is sure enough, the surest first, if both are modified and neither it nor a neighbour of it took part in a swap before. value: the text, of swapped rows with
    adjusted boundaries. rows: pair_id, seq (from 1, without gaps), classification, text. A pair has MOST sliders at most, which one row holds."""
    w = Window.partitionBy("pair_id").orderBy("seq")
    is_modified = lambda c: F.coalesce(c == "modified", F.lit(False))
    near = rows.select("pair_id", "seq", is_modified(F.lag("classification").over(w)).alias("on_left"), is_modified(F.lead("classification").over(w)).alias("on_right"))
    left, right, cur = F.col("left_score"), F.col("right_score"), F.col("current_score")
    x = s.where(F.col("confidence") >= threshold).join(near, ["pair_id", "seq"])
    to = F.when((right > left) & (right > cur), 1).when((left > cur), -1).otherwise(0)
    x = x.withColumn("to", to.cast("int")).where(((F.col("to") == 1) & F.col("on_right")) | ((F.col("to") == -1) & F.col("on_left")))
    x = x.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("place", "seq", "to"))).alias("all"))
    none = F.array().cast("array<struct<a:int,b:int>>")

    def step(done: Column, v: Column) -> Column:
        clash = F.exists(done, lambda d: (F.abs(d["a"] - v["seq"]) <= 1) | (F.abs(d["b"] - v["seq"]) <= 1))
        return F.when(clash, done).otherwise(F.concat(done, F.array(F.struct(v["seq"].alias("a"), (v["seq"] + v["to"]).alias("b")))))

    swaps = x.select("pair_id", F.explode(F.aggregate("all", none, step)).alias("x"))
    swaps = swaps.select("pair_id", F.explode(F.array(F.struct(F.col("x.a").alias("seq"), F.col("x.b").alias("to")), F.struct(F.col("x.b").alias("seq"), F.col("x.a").alias("to")))).alias("x")).select("pair_id", "x.*")
    out = rows.join(swaps, ["pair_id", "seq"], "left")
    return out.withColumn("value", F.when(F.col("to").isNotNull(), adjust_boundaries(F.col("text"), language)).otherwise(F.col("text"))).withColumn("new_seq", F.coalesce("to", "seq")).drop("to")
