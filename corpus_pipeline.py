"""The corpus pipeline: quality, toxicity, near duplicates, decontamination, tokens. Each stage works on all rows its predecessor kept.

All stages but the last return the columns of their input, whatever else these are named, and read doc_id and text alone. Ids may be null or repeat; an empty table gives an empty one; texts of any length are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimp.llm import bpe, decontaminate, ngram_join, quality, toxicity
from palimp.llm.labelled import crc_of_id
from palimp.llm.queries import tokenizer_path
from palimp.llm.shared import table, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of 1/2 or more. It learns from the labels that op5 learns from. Null and empty texts have the score of one empty line; equal texts have equal scores, so repeated rows stay or go together."""
    model = quality.learn_quality(docs, table(spark, sf_dir, "labels"), crc_of_id(F.col("doc_id")) % 4 != 2)
    return quality.keep_scored(docs, model, lambda s: s >= 0.5)


def keep_harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below ACCEPT; a score equal to it is toxic. Null and empty texts, and texts without a word, aren't toxic; repeated rows stay or go together."""
    model = toxicity.learn_toxicity(docs, table(spark, sf_dir, "labels"), crc_of_id(F.col("doc_id")) % 3 != 1)
    return quality.keep_scored(docs, model, lambda s: s < toxicity.ACCEPT)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8): the row with the smallest id, null first. A row is known by its id and the hash of its text, so rows with other texts under the
    same id are documents of their own, and of rows that repeat both one stays. Null and empty texts, and texts without words, are no duplicates of anything: they stay."""
    key = F.struct(F.col("doc_id"), F.xxhash64(F.coalesce("text", F.lit("")), F.col("text").isNull()).alias("hash")).alias("_row_key")
    found = ngram_join.ngram_join(docs.select(key, "text"), 5, 80, id_col="_row_key").withColumnRenamed("doc_id", "_row_key")
    others = found.where("_row_key != component_id").select("_row_key").distinct()
    repeated = found.where("_row_key = component_id and n_shingles > 0").groupBy("_row_key").agg(F.count("*").alias("n")).where("n > 1").select("_row_key")
    kept = docs.withColumn("_row_key", key).join(others, "_row_key", "left_anti")
    if not repeated.isEmpty():
        kept = kept.join(repeated, "_row_key", "left_anti").unionByName(kept.join(repeated, "_row_key", "left_semi").dropDuplicates(["_row_key"]))
    return kept.select(docs.columns)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item, as find_leaks defines it. Null and empty texts stay, null and empty items match nothing; repeated rows stay or go together."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of the text decoded from them, a row for each row. Null texts are empty ones, with no token."""
    return bpe.encode_digest(docs, tokenizer_path())


STAGES = [("quality", keep_quality), ("toxicity", keep_harmless), ("near_duplicates", keep_distinct), ("decontamination", keep_uncontaminated), ("bpe", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each stage's rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
