"""Connected components of a link table by alternating large and small stars; nothing goes to the driver but a count and a checksum."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import forget, written

#: From this many links on, nodes with more than the share HOT of them are joined by a broadcast: 2 / HOT nodes at most. With fewer links a node's share is small anyway, and broadcasts cost more than they save.
MANY, HOT = 5_000_000, 0.001


def _sum(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _with_lowest(links: DataFrame, low: DataFrame, total: int) -> DataFrame:
    """links (u, v) with m of their u in low (u, m, n: its links). Of many links, the few nodes that hold a large share are broadcast, so their links stay where they are; the others meet by a shuffle."""
    if total < MANY:
        return links.join(low.select("u", "m"), "u")
    hot = F.col("n") > int(total * HOT)
    often = F.broadcast(low.where(hot).select("u", "m"))
    return links.join(often, "u").unionByName(links.join(often.select("u"), "u", "left_anti").join(low.where(~hot).select("u", "m"), "u"))


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """node, root (the smallest node of its component) for every node of the links; links with a null end or of a node to itself give nothing."""
    e = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where((F.col(a) != F.col(b))).distinct()
    e = written(e, "links")
    seen = _sum(e)
    while seen[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = _with_lowest(both, low, seen[0]).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = _with_lowest(large, low, seen[0])
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*").where("u != v").distinct()
        new = written(small, "links")
        now = _sum(new)
        forget(e)
        e = new
        if now == seen:
            break
        seen = now
    out = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return out.union(out.select("root", "root").distinct())
