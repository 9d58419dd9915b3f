"""Resharding: the law of equal bytes, least moved bytes, what moves and what doesn't, and a driver that is lost between moves."""

import random

import pytest
from pyspark.sql import functions as F

from palimp.llm import reshard
from palimp.llm.shared import fresh_dir


def documents(spark, n, seed):
    rng = random.Random(seed)
    return spark.createDataFrame([(i, "x" * int(rng.paretovariate(1.2) * 20)) for i in range(n)], "doc_id long, text string")


def sizes_by(spark, path, *cols):
    return {tuple(r[c] for c in cols): r["n"] for r in spark.read.parquet(path).groupBy(*cols).agg(F.sum(reshard.text_size(F.col("text"))).alias("n")).collect()}


@pytest.mark.parametrize("old,new,seed", [(3, 5, 1), (5, 3, 2), (4, 4, 3), (2, 9, 4)])
def test_equal_bytes_and_least_moves(spark, old, new, seed):
    docs = documents(spark, 400, seed)
    path = fresh_dir(spark, "layout-test")
    reshard.lay_out(docs, F.col("doc_id") % F.lit(old) % F.lit(2), old, path)  # uneven: two shards hold all
    supply = sizes_by(spark, path, "old")
    plan = reshard.reshard(spark, path, old, new)
    total, largest = sum(supply.values()), docs.agg(F.max(reshard.text_size(F.col("text")))).first()[0]
    got = sizes_by(spark, path, "shard")
    assert all(abs(got.get((j,), 0) - total / new) <= largest + 1 for j in range(new)) and sum(got.values()) == total
    capacity = [total * (j + 1) // new - total * j // new for j in range(new)]
    least = total - sum(min(supply.get((j,), 0), capacity[j]) for j in range(min(old, new)))
    assert sum(x for (i, j), x in plan.flows.items() if i != j) == least
    moved = sum(n for (j, i), n in sizes_by(spark, path, "shard", "old").items() if i != j)
    assert abs(moved - least) <= largest * new
    assert sorted(map(str, spark.read.parquet(path).select("doc_id", "text").collect())) == sorted(map(str, docs.collect()))


@pytest.mark.parametrize("after", [0, 1, 2, 5])
def test_lost_driver(spark, after, monkeypatch):
    docs = documents(spark, 300, 7)
    path = fresh_dir(spark, "layout-test")
    reshard.lay_out(docs, F.lit(0), 2, path)
    steps = [0]

    class Pool:
        def __init__(self, n):
            pass

        def __enter__(self):
            return self

        def __exit__(self, *a):
            pass

        def map(self, f, items):
            for x in items:
                if steps[0] == after:
                    raise KeyboardInterrupt
                steps[0] += 1
                yield f(x)

    with monkeypatch.context() as m:
        m.setattr(reshard, "ThreadPoolExecutor", Pool)
        try:
            reshard.reshard(spark, path, 2, 6)
        except KeyboardInterrupt:
            pass
    reshard.finish_moves(spark, path)
    assert not reshard.finish_moves(spark, path)
    assert sorted(map(str, spark.read.parquet(path).select("doc_id", "text").collect())) == sorted(map(str, docs.collect()))
    got = sizes_by(spark, path, "shard")
    assert len(got) == 6


def test_clashing_columns(spark):
    docs = documents(spark, 20, 1).withColumn("shard", F.lit("a")).withColumn("blk", F.lit("b"))
    path = fresh_dir(spark, "layout-test")
    reshard.lay_out(docs, F.col("doc_id"), 3, path)
    reshard.reshard(spark, path, 3, 4)
    assert spark.read.parquet(path).where("shard_of_document = 'a' and blk_of_document = 'b'").count() == 20
