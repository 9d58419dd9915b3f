"""Full comparison of version pairs: edit script, change blocks, pairing, moves, one class for each row, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimp.config import DEFAULT, Options
from palimp.functions.edit import char_diff, word_diff
from palimp.functions.text import lines_of, normalize_delimiters
from palimp.operators.align import change_blocks, line_edits, two_pass_edits
from palimp.operators.compact import compare_pairs
from palimp.operators.late_moves import apply_moves, late_moves
from palimp.storage import written
from palimp.operators.matching import block_moves, candidates, exact_moves, greedy_pairs, similar_moves, unpaired

CLASSES = ("added", "removed", "modified", "moved", "unchanged")


def complexity(edits: DataFrame, options: Options = DEFAULT) -> DataFrame:
    """pair_id, lines, n_removed, n_added, route: fast where the pair has too many lines or combinations of changed lines, else two_pass or single_pass by its lines."""
    x = edits.groupBy("pair_id").agg((F.count("old_no") + F.count("new_no")).alias("lines"), F.count_if(F.col("op") == "-").alias("n_removed"), F.count_if(F.col("op") == "+").alias("n_added"))
    too_large = (F.col("lines") > options.max_lines) | (F.col("n_removed") * F.col("n_added") > options.max_pairs)
    return x.withColumn("route", F.when(too_large & F.lit(options.fast_mode), "fast").when(F.col("lines") > options.two_pass_threshold, "two_pass").otherwise("single_pass"))


def classify_fast(edits: DataFrame) -> DataFrame:
    """Degraded mode: the n-th removed line of a block and its n-th added line are modified."""
    from pyspark.sql import Window

    b = change_blocks(edits)
    n = F.row_number().over(Window.partitionBy("pair_id", "block_id", "op").orderBy("seq"))
    b = b.withColumn("n", n)
    a, c = b.where("op = '-'"), b.where("op = '+'")
    m = a.select("pair_id", "block_id", "n", "seq", "old_no", F.col("line").alias("removed_line")).join(c.select("pair_id", "block_id", "n", F.col("seq").alias("s2"), "new_no", F.col("line").alias("added_line")), ["pair_id", "block_id", "n"], "full")
    kind = F.when(F.col("removed_line").isNull(), "added").when(F.col("added_line").isNull(), "removed").otherwise("modified")
    return _rows(m.select("pair_id", F.coalesce("seq", "s2").alias("seq"), kind.alias("classification"), "old_no", "new_no", "removed_line", "added_line", F.lit(None).cast("double").alias("similarity")), edits)


def _rows(changed: DataFrame, edits: DataFrame) -> DataFrame:
    same = edits.where("op = '='").select("pair_id", "seq", F.lit("unchanged").alias("classification"), "old_no", "new_no", F.col("line").alias("removed_line"), F.col("line").alias("added_line"), F.lit(1.0).alias("similarity"))
    return changed.unionByName(same)


def classify(edits: DataFrame, options: Options = DEFAULT) -> DataFrame:
    """pair_id, seq, classification, old_no, new_no, removed_line, added_line, similarity: one row for each line, or pair of lines; block-moved before modified, moved, removed and added."""
    blocks = written(change_blocks(edits), "blocks")
    lines = edits.select("pair_id", "seq", "op", "old_no", "new_no", "line")
    moved = block_moves(blocks, options) if options.detect_moves else None
    taken = []
    if moved is not None:
        big = moved.where("size >= 2").select("pair_id", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1)).alias("k", "o"), "start_old", "start_new")
        big = big.select("pair_id", (F.col("start_old") + F.col("o")).cast("int").alias("old_no"), (F.col("start_new") + F.col("o")).cast("int").alias("new_no"), F.lit(1.0).alias("similarity"), F.lit("block-moved").alias("classification"))
        big = written(big, "block-moves")
        taken.append(big)
        blocks = written(unpaired(blocks, big), "blocks")
    pairs = written(greedy_pairs(candidates(blocks, options, options.modified_threshold), options.modified_threshold), "pairings")
    taken.append(pairs.select("pair_id", "old_no", "new_no", F.col("sim").alias("similarity"), F.lit("modified").alias("classification")))
    rest = written(unpaired(blocks, pairs), "rest")
    if options.detect_moves:
        exact = written(exact_moves(rest).select("pair_id", F.col("from_no").alias("old_no"), F.col("to_no").alias("new_no")), "moves")
        taken.append(exact.select("pair_id", "old_no", "new_no", F.lit(1.0).alias("similarity"), F.lit("moved").alias("classification")))
        rest = written(unpaired(rest, exact), "rest")
        # moves first, then modifications across blocks: both in one greedy run
        alike = written(similar_moves(rest, min(options.move_threshold, options.modified_threshold)), "moves")
        kind = F.when(F.col("sim") >= options.move_threshold, "moved").otherwise("modified")
        taken.append(alike.select("pair_id", "old_no", "new_no", F.col("sim").alias("similarity"), kind.alias("classification")))
        rest = written(unpaired(rest, alike), "rest")
    both = taken[0]
    for x in taken[1:]:
        both = both.unionByName(x)
    a = lines.where("op = '-'").select("pair_id", "old_no", "seq", F.col("line").alias("removed_line"))
    b = lines.where("op = '+'").select("pair_id", "new_no", F.col("seq").alias("s2"), F.col("line").alias("added_line"))
    both = both.join(a, ["pair_id", "old_no"]).join(b, ["pair_id", "new_no"])
    both = both.select("pair_id", F.least("seq", "s2").alias("seq"), "classification", "old_no", "new_no", "removed_line", "added_line", "similarity")
    single = rest.select("pair_id", "seq", F.when(F.col("op") == "-", "removed").otherwise("added").alias("classification"), "old_no", "new_no", F.when(F.col("op") == "-", F.col("line")).alias("removed_line"), F.when(F.col("op") == "+", F.col("line")).alias("added_line"), F.lit(None).cast("double").alias("similarity"))
    return _rows(both.unionByName(single), edits)


def _edits(pairs: DataFrame, options: Options) -> DataFrame:
    """Edit rows: of pairs with more lines than the threshold in two passes, a task for each region; of the others in one."""
    n = sum(F.size(lines_of(F.coalesce(c, F.lit("")))) for c in ("old_text", "new_text"))
    large, small = pairs.where(n > options.two_pass_threshold), pairs.where(n <= options.two_pass_threshold)
    lines = lambda c: large.select("pair_id", F.posexplode(lines_of(F.coalesce(c, F.lit("")))).alias("line_no", "line"))
    return line_edits(small).unionByName(two_pass_edits(lines("old_text"), lines("new_text")))


def compare(pairs: DataFrame, options: Options = DEFAULT, scripts: bool = False) -> DataFrame:
    """Classified rows of pairs (pair_id, old_text, new_text). Pairs beyond the limits take the degraded mode. scripts: also word_diff and char_diff of modified rows.

    With a degraded mode, which bounds the work on a pair, pairs are compared one by one in their tasks, without a shuffle. Without one (fast_mode is off), they are compared as tables of lines, which large pairs are spread over.
    """
    if options.normalize_delimiters:
        pairs = pairs.withColumn("old_text", normalize_delimiters("old_text", options.language)).withColumn("new_text", normalize_delimiters("new_text", options.language))
    out = compare_pairs(pairs, options) if options.fast_mode else classify(written(_edits(pairs, options), "edits"), options)
    if options.late_moves:
        out = apply_moves(out, late_moves(pairs))
    if scripts:
        m = out.where("classification = 'modified'").withColumn("word_diff", word_diff("removed_line", "added_line")).withColumn("char_diff", char_diff("removed_line", "added_line"))
        out = m.unionByName(out.where("classification != 'modified'"), allowMissingColumns=True)
    return out


def stats(classified: DataFrame) -> DataFrame:
    """Rows of each class by pair; total_changes counts all rows, moved includes moved blocks."""
    c = F.col("classification")
    return classified.groupBy("pair_id").agg(F.count("*").alias("total_changes"), *(F.count_if(c.isin("moved", "block-moved", "moved-modified") if k == "moved" else c == k).alias(k) for k in CLASSES))
