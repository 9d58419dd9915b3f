"""Results as patches and as two columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def side_by_side(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both sides on the row of their number; a missing side is null."""
    a, b = old.select("pair_id", "line_no", F.col("line").alias("old_line")), new.select("pair_id", "line_no", F.col("line").alias("new_line"))
    return a.join(b, ["pair_id", "line_no"], "full").select("pair_id", "line_no", "old_line", "new_line")


def unified_patch(edits: DataFrame, context: int = 3) -> DataFrame:
    """pair_id, hunk, header, body: changed rows with `context` rows around; hunks that touch are one."""
    w = Window.partitionBy("pair_id").orderBy("seq")
    near = F.max(F.when(F.col("op") != "=", 1).otherwise(0)).over(w.rowsBetween(-context, context))
    before = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = edits.withColumn("near", near).withColumn("o", F.count("old_no").over(before)).withColumn("n", F.count("new_no").over(before)).where("near = 1")
    x = x.withColumn("hunk", F.sum(F.when(F.col("seq") - F.lag("seq").over(w) == 1, 0).otherwise(1)).over(before))
    sign = F.when(F.col("op") == "=", " ").otherwise(F.col("op"))
    g = x.groupBy("pair_id", "hunk").agg(F.min("seq").alias("s"), (F.min(F.col("o") - F.when(F.col("old_no").isNotNull(), 1).otherwise(0)) + 1).alias("a"), F.count("old_no").alias("na"), (F.min(F.col("n") - F.when(F.col("new_no").isNotNull(), 1).otherwise(0)) + 1).alias("b"), F.count("new_no").alias("nb"), F.array_sort(F.collect_list(F.struct("seq", F.concat(sign, "line").alias("t")))).alias("rows"))
    return g.select("pair_id", "hunk", F.concat(F.lit("@@ -"), "a", F.lit(","), "na", F.lit(" +"), "b", F.lit(","), "nb", F.lit(" @@")).alias("header"), F.array_join(F.col("rows.t"), "\n").alias("body"))
