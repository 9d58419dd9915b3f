"""Alignment of line tables: unique common lines, regions between anchors, change blocks, shifted stretches, diagonal runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimp.functions.edit import edit_script, lis, region_script
from palimp.functions.text import lines_of


def unique_anchors(old: DataFrame, new: DataFrame) -> DataFrame:
    """Lines that occur once on both sides: pair_id, old_no, new_no, line. One aggregation of each side by (pair, line), then a join on the same key."""

    def once(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("pair_id", "line").agg(F.count("*").alias("c"), F.min("line_no").alias(name)).where("c = 1").drop("c")

    return once(old, "old_no").join(once(new, "new_no"), ["pair_id", "line"]).select("pair_id", "old_no", "new_no", "line")


def increasing_anchors(anchors: DataFrame) -> DataFrame:
    """The anchors on a longest increasing subsequence of new_no in the order of old_no."""
    grouped = anchors.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("old_no", "new_no"))).alias("a"))
    kept = grouped.withColumn("i", lis(F.col("a.new_no")))
    return kept.select("pair_id", F.explode("i").alias("k"), "a").select("pair_id", F.expr("a[k].old_no").alias("old_no"), F.expr("a[k].new_no").alias("new_no"))


def changed_regions(anchors: DataFrame, sizes: DataFrame) -> DataFrame:
    """Stretches between increasing anchors, ends exclusive; sizes: pair_id, n_old, n_new."""
    ends = sizes.select("pair_id", F.col("n_old").alias("old_no"), F.col("n_new").alias("new_no"))
    w = Window.partitionBy("pair_id").orderBy("old_no", "new_no")
    all_ = anchors.select("pair_id", "old_no", "new_no").union(ends)
    out = all_.select("pair_id", (F.coalesce(F.lag("old_no").over(w), F.lit(-1)) + 1).alias("old_start"), F.col("old_no").alias("old_end"), (F.coalesce(F.lag("new_no").over(w), F.lit(-1)) + 1).alias("new_start"), F.col("new_no").alias("new_end"))
    return out.where("old_start < old_end or new_start < new_end")


def line_edits(pairs: DataFrame) -> DataFrame:
    """pair_id, seq, op, old_no, new_no, line of the shortest edit script of each pair (old_text, new_text)."""
    x = pairs.select("pair_id", lines_of(F.coalesce("old_text", F.lit(""))).alias("a"), lines_of(F.coalesce("new_text", F.lit(""))).alias("b"))
    x = x.withColumn("s", edit_script("a", "b")).select("pair_id", "a", "b", F.posexplode("s").alias("seq", "e"))
    return x.select("pair_id", "seq", "e.op", "e.old_no", "e.new_no", F.when(F.col("e.old_no").isNotNull(), F.expr("a[e.old_no]")).otherwise(F.expr("b[e.new_no]")).alias("line"))


def two_pass_edits(old: DataFrame, new: DataFrame) -> DataFrame:
    """pair_id, seq, op, old_no, new_no, line by two passes: the increasing unique common lines are unchanged; then each region between them gets an edit script of its own, a row each, so a large pair is many small tasks.

    old, new: pair_id, line_no, line. The rows are those of line_edits.
    """
    same = increasing_anchors(unique_anchors(old, new))
    count = lambda df, c: df.groupBy("pair_id").agg(F.count("*").cast("int").alias(c))
    sizes = count(old, "n_old").join(count(new, "n_new"), "pair_id", "full").fillna(0, ["n_old", "n_new"])
    regions = changed_regions(same, sizes)

    def lines(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
        x = regions.where(f"{a} < {b}").select("pair_id", "old_start", "new_start", F.explode(F.sequence(F.col(a), F.col(b) - 1)).alias("line_no")).join(df, ["pair_id", "line_no"])
        return x.groupBy("pair_id", "old_start", "new_start").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda v: v["line"]).alias(name))

    r = lines(old, "old_start", "old_end", "a").join(lines(new, "new_start", "new_end", "b"), ["pair_id", "old_start", "new_start"], "full")
    none = F.array().cast("array<string>")
    r = r.select("pair_id", "old_start", "new_start", F.coalesce("a", none).alias("a"), F.coalesce("b", none).alias("b"))
    r = r.withColumn("s", region_script("a", "b")).select("pair_id", "old_start", "new_start", "a", "b", F.posexplode("s").alias("k", "e"))
    r = r.select("pair_id", F.col("old_start").alias("p"), F.col("new_start").alias("q"), F.lit(0).alias("anchor"), "k", "e.op", (F.col("e.old_no") + F.col("old_start")).alias("old_no"), (F.col("e.new_no") + F.col("new_start")).alias("new_no"), F.when(F.col("e.old_no").isNotNull(), F.expr("a[e.old_no]")).otherwise(F.expr("b[e.new_no]")).alias("line"))
    a = same.join(old.withColumnRenamed("line_no", "old_no"), ["pair_id", "old_no"])
    a = a.select("pair_id", F.col("old_no").alias("p"), F.col("new_no").alias("q"), F.lit(1).alias("anchor"), F.lit(0).alias("k"), F.lit("=").alias("op"), "old_no", "new_no", "line")
    # of a region and an anchor at the same places, the region comes first
    seq = F.row_number().over(Window.partitionBy("pair_id").orderBy("p", "q", "anchor", "k")) - 1
    return r.unionByName(a).select("pair_id", seq.alias("seq"), "op", "old_no", "new_no", "line")


def change_blocks(edits: DataFrame) -> DataFrame:
    """The changed rows with block_id: runs that no unchanged row divides."""
    w = Window.partitionBy("pair_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return edits.withColumn("block_id", F.sum(F.when(F.col("op") == "=", 1).otherwise(0)).over(w)).where("op != '='")


def shifted_stretches(anchors: DataFrame, least: int = 2) -> DataFrame:
    """Unchanged lines that moved by `least` or more, as consecutive blocks: pair_id, shift, start_old, start_new, size."""
    x = anchors.withColumn("shift", F.col("new_no") - F.col("old_no")).where(F.abs("shift") >= least)
    w = Window.partitionBy("pair_id", "shift").orderBy("new_no")
    x = x.withColumn("island", F.col("new_no") - F.row_number().over(w))
    return x.groupBy("pair_id", "shift", "island").agg(F.min("old_no").alias("start_old"), F.min("new_no").alias("start_new"), F.count("*").alias("size")).drop("island")


def diagonal_runs(old: DataFrame, new: DataFrame) -> DataFrame:
    """Maximal runs of equal lines at a constant offset: pair_id, start_old, start_new, size. Stretches of one repeated line meet as wholes: p and q such lines make p + q - 1 pieces of diagonals, not p times q rows."""

    def stretches(df: DataFrame, name: str) -> DataFrame:
        x = df.withColumn("g", F.col("line_no") - F.dense_rank().over(Window.partitionBy("pair_id", "line").orderBy("line_no")))
        return x.groupBy("pair_id", "line", "g").agg(F.min("line_no").alias(f"{name}0"), F.max("line_no").alias(f"{name}1")).drop("g")

    x = stretches(old, "a").join(stretches(new, "b"), ["pair_id", "line"])
    x = x.withColumn("d", F.explode(F.sequence(F.col("a0") - F.col("b1"), F.col("a1") - F.col("b0"))))
    x = x.select("pair_id", "d", F.greatest("a0", F.col("b0") + F.col("d")).alias("i"), F.least("a1", F.col("b1") + F.col("d")).alias("last"))
    # the lines of a diagonal before a piece, taken from its start, are the same for pieces that touch
    before = F.sum(F.col("last") - F.col("i") + 1).over(Window.partitionBy("pair_id", "d").orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
    x = x.withColumn("island", F.col("i") - F.coalesce(before, F.lit(0)))
    x = x.groupBy("pair_id", "d", "island").agg(F.min("i").alias("start_old"), (F.max("last") - F.min("i") + 1).cast("long").alias("size"))
    return x.select("pair_id", "start_old", (F.col("start_old") - F.col("d")).alias("start_new"), "size")


def content_windows(old: DataFrame, new: DataFrame, k: int, least_chars: int = 10) -> DataFrame:
    """Windows of k lines whose trimmed lines, of least_chars or more, are the same multiset on both sides: pair_id, start_old, start_new; each old window with its first match."""

    def windows(df: DataFrame, name: str) -> DataFrame:
        w = Window.partitionBy("pair_id").orderBy("line_no").rowsBetween(0, k - 1)
        t = df.withColumn("t", F.regexp_replace("line", r"^\s+|\s+$", ""))
        t = t.withColumn("ws", F.collect_list("t").over(w)).where(F.size("ws") == k)
        t = t.where(~F.exists("ws", lambda x: F.length(x) < least_chars))
        return t.select("pair_id", F.array_join(F.array_sort("ws"), "\n").alias("key"), F.col("line_no").alias(name))

    return windows(old, "start_old").join(windows(new, "start_new"), ["pair_id", "key"]).groupBy("pair_id", "start_old").agg(F.min("start_new").alias("start_new"))


def patience_rows(old: DataFrame, new: DataFrame) -> DataFrame:
    """pair_id, op, old_no, new_no, line: only unique common lines in increasing order are equal, all other lines are removed or added."""
    same = increasing_anchors(unique_anchors(old, new))
    a = old.withColumnRenamed("line_no", "old_no").join(same, ["pair_id", "old_no"], "left")
    b = new.withColumnRenamed("line_no", "new_no").join(same.select("pair_id", "new_no"), ["pair_id", "new_no"], "left_anti")
    a = a.select("pair_id", F.when(F.col("new_no").isNull(), "-").otherwise("=").alias("op"), "old_no", "new_no", "line")
    return a.unionByName(b.select("pair_id", F.lit("+").alias("op"), F.lit(None).cast("int").alias("old_no"), "new_no", "line"))


def block_signatures(lines: DataFrame, sig_col: str, k: int = 3) -> DataFrame:
    """pair_id, line_no, signature of each window of k lines, from the lines' signatures."""
    w = Window.partitionBy("pair_id").orderBy("line_no")
    value = F.lit(0).cast("long")
    for i in range(k):
        value = (value * 31 + F.lead(sig_col, i).over(w)) % 4294967296
    return lines.select("pair_id", "line_no", value.alias("signature")).where(F.col("signature").isNotNull())
