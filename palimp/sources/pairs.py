"""Sources of version pairs and of their lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimp.functions.text import lines_of
from palimp.session import ship
from palimp.storage import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan with fewer tasks than the session has cores, dealt out to all cores, for queries that compute much for each row. Larger scans stay as they are, so this shuffle is bounded by the cores times the size of a split."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def explode_lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, line_no (from 0), line; a final empty line counts."""
    return df.select(F.col(id_col), F.posexplode(lines_of(F.col(text_col))).alias("line_no", "line"))


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """filename, text of whole files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("filename"), F.col("value").alias("text"))


def turn_pairs(conversations: DataFrame) -> DataFrame:
    """Consecutive turns as versions: conv_id, turn, old_text, new_text."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    out = conversations.select("conv_id", "turn", F.lag("text").over(w).alias("old_text"), F.col("text").alias("new_text"))
    return out.where("old_text is not null")


def near_copy_pairs(documents: DataFrame, shared: float = 0.3, least_chars: int = 20, hot: int | None = None) -> DataFrame:
    """Documents that share lines: a_id < b_id, common. With `hot`, lines of more documents than that don't count; without, all lines do.

    Documents with the same long lines and as many lines make a class, and classes are compared. A class is looked up by its rarest lines only, one more than it can miss: two that share enough
    have one of these in common, so the lines of most documents are rarely joined, and none is left out of the count. Lines are known by 128 bits of a hash.
    """
    lines = lines_of(F.col("text"))
    size = documents.select("doc_id", F.size(lines).cast("long").alias("n")).where("n > 0").groupBy("doc_id").agg(F.sum("n").alias("n"))
    hashed = F.transform(F.array_distinct(F.filter(lines, lambda x: F.length(x) > least_chars)), lambda x: F.unhex(F.substring(F.sha2(x.cast("binary"), 256), 1, 32)))
    long_lines = documents.select("doc_id", F.explode(hashed).alias("h")).distinct()
    met = long_lines.groupBy("h").agg(F.count("*").alias("docs")).where(F.col("docs") >= 2)
    met = met if hot is None else met.where(F.col("docs") <= hot)
    sets = long_lines.join(met, "h").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("docs", "h"))).alias("s")).join(size, "doc_id").withColumn("s", F.col("s.h"))
    # a little less than the share, so that rounding leaves nothing out before the test itself
    need = F.greatest(F.lit(1), F.ceil(F.col("n") * shared - 1e-6)).cast("int")
    key = F.sha2(F.concat(F.aggregate("s", F.lit(b""), lambda x, h: F.concat(x, h)), F.col("n").cast("string").cast("binary")), 256)
    sets = written(sets.withColumn("look", F.size("s") - need + 1).where("look > 0").withColumn("k", key), "line-sets")
    first = written(sets.groupBy("k").agg(F.min("doc_id").alias("c"), F.count("*").alias("docs")), "classes")
    of = sets.select("doc_id", "k").join(first.select("k", "c"), "k").select("doc_id", "c")
    classes = sets.select(F.col("doc_id").alias("c"), "s", "n", "look").join(first.select("c", "docs"), "c")
    look = classes.select("c", F.explode(F.slice("s", F.lit(1), F.col("look"))).alias("h"))
    near = look.select("h", F.col("c").alias("x")).join(look.select("h", F.col("c").alias("y")), "h").where("x < y").select("x", "y").distinct()
    near = near.join(classes.select(F.col("c").alias("x"), F.col("s").alias("sx"), F.col("n").alias("nx")), "x").join(classes.select(F.col("c").alias("y"), F.col("s").alias("sy"), F.col("n").alias("ny")), "y")
    near = near.select("x", "y", F.size(F.array_intersect("sx", "sy")).cast("long").alias("common"), F.greatest("nx", "ny").alias("most"))
    same = classes.where("docs > 1").select(F.col("c").alias("x"), F.col("c").alias("y"), F.size("s").cast("long").alias("common"), F.col("n").alias("most"))
    links = near.union(same).where(F.col("common") / F.col("most") >= shared)
    out = links.join(of.select(F.col("c").alias("x"), F.col("doc_id").alias("p")), "x").join(of.select(F.col("c").alias("y"), F.col("doc_id").alias("q")), "y").where("x != y or p < q")
    return out.select(F.least("p", "q").alias("a_id"), F.greatest("p", "q").alias("b_id"), "common")


def edited_lines(documents: DataFrame, least: int = 10) -> tuple[DataFrame, DataFrame]:
    """Old and new lines (pair_id, line_no, line) of documents with `least` lines or more and an edit by position: lines are deleted, changed, doubled, and the first three go to the end."""
    text = documents.where(F.size(lines_of(F.col("text"))) >= least).select(F.col("doc_id").alias("pair_id"), "text")
    old = explode_lines(text, "pair_id", "text")
    new = old.where(F.col("line_no") % 7 != 3).withColumn("copy", F.explode(F.when(F.col("line_no") % 11 == 4, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    new = new.withColumn("line", F.when(F.col("line_no") % 5 == 4, F.concat("line", F.lit(" edited"))).otherwise(F.col("line")))
    w = Window.partitionBy("pair_id").orderBy(F.col("line_no") < 3, "line_no", "copy")
    return old, new.select("pair_id", (F.row_number().over(w) - 1).alias("line_no"), "line")


def edited_pairs(documents: DataFrame, least: int = 10) -> DataFrame:
    """pair_id, old_text, new_text of the same edit, in one pass without a shuffle: new positions are an order of the array."""
    old = lines_of(F.col("text"))
    n = F.size(old)
    kept = F.filter(F.sequence(F.lit(0), n - 1), lambda i: i % 7 != 3)
    doubled = F.flatten(F.transform(kept, lambda i: F.when(i % 11 == 4, F.array(i, i)).otherwise(F.array(i))))
    order = F.concat(F.filter(doubled, lambda i: i >= 3), F.filter(doubled, lambda i: i < 3))
    new = F.transform(order, lambda i: F.when(i % 5 == 4, F.concat(F.element_at(old, i + 1), F.lit(" edited"))).otherwise(F.element_at(old, i + 1)))
    return documents.where(n >= least).select(F.col("doc_id").alias("pair_id"), F.col("text").alias("old_text"), F.array_join(new, "\n").alias("new_text"))
