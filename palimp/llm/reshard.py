"""Resharding by minimum-cost flow: from old shard sizes and new capacities, the transfers that move the fewest bytes; then only affected files are rewritten.

A layout is a folder shard=S/old=O/blk=B of Parquet files; a block is a hash range of an old shard, with about BLOCK_ROWS rows. The flow from old shards to new ones costs nothing where the number stays
and 1 per byte elsewhere. Of each old shard, whole blocks fill its flows first; they stay, or their folder is renamed. The few blocks that remain are split between
the flows that still lack bytes: their documents go, the largest first, to the flow that lacks most. Only those blocks are rewritten.
"""

from __future__ import annotations

import heapq
import json
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import drop_path, fresh_dir

#: Rows of a block, and blocks in all at most (the driver plans blocks).
BLOCK_ROWS, MAX_BLOCKS = 2000, 65_536


def min_cost_flow(supply: list[int], capacity: list[int], cost) -> dict[tuple[int, int], int]:
    """Amounts (i, j) > 0 that send all supplies to capacities at the least cost(i, j) per unit, by successive shortest paths with potentials. Supplies may not exceed capacities in all."""
    m, n = len(supply), len(capacity)
    source, sink = m + n, m + n + 1
    edges: list[list[int]] = []  # to, left, cost
    out: list[list[int]] = [[] for _ in range(m + n + 2)]

    def add(a: int, b: int, room: int, price: int) -> None:
        out[a].append(len(edges))
        edges.append([b, room, price])
        out[b].append(len(edges))
        edges.append([a, 0, -price])

    for i, s in enumerate(supply):
        add(source, i, s, 0)
    for j, c in enumerate(capacity):
        add(m + j, sink, c, 0)
    at = {}
    for i in range(m):
        for j in range(n):
            at[i, j] = len(edges)
            add(i, m + j, supply[i], cost(i, j))
    height = [0] * (m + n + 2)
    while True:
        far = [float("inf")] * (m + n + 2)
        by: list[int | None] = [None] * (m + n + 2)
        far[source] = 0
        queue = [(0, source)]
        while queue:
            d, a = heapq.heappop(queue)
            if d > far[a]:
                continue
            for e in out[a]:
                b, room, price = edges[e]
                if room > 0 and (x := d + price + height[a] - height[b]) < far[b]:
                    far[b], by[b] = x, e
                    heapq.heappush(queue, (x, b))
        if by[sink] is None:
            break
        for k, d in enumerate(far):
            if d < float("inf"):
                height[k] += d
        path, a = [], sink
        while a != source:
            path.append(by[a])
            a = edges[by[a] ^ 1][0]
        amount = min(edges[e][1] for e in path)
        for e in path:
            edges[e][1] -= amount
            edges[e ^ 1][1] += amount
    return {k: x for k, e in at.items() if (x := edges[e ^ 1][1]) > 0}


@dataclass
class Plan:
    whole: dict[tuple[int, int], int] = field(default_factory=dict)  # (old shard, block) -> new shard
    split: dict[tuple[int, int], list[tuple[int, int]]] = field(default_factory=dict)  # (old shard, block) -> new shards and bytes
    flows: dict[tuple[int, int], int] = field(default_factory=dict)


def plan_blocks(blocks: dict[tuple[int, int], int], old: int, new: int) -> Plan:
    """Where each block of old shards goes; blocks: bytes of (old shard, block). Capacities are equal, up to a byte."""
    supply = [0] * old
    for (i, _), size in blocks.items():
        supply[i] += size
    total = sum(supply)
    capacity = [total * (j + 1) // new - total * j // new for j in range(new)]
    plan = Plan(flows=min_cost_flow(supply, capacity, lambda i, j: int(i != j)))
    for i in range(old):
        room = {j: x for (a, j), x in plan.flows.items() if a == i}
        rest = []
        for (_, b), size in sorted(((k, v) for k, v in blocks.items() if k[0] == i), key=lambda x: (-x[1], x[0])):
            j = max(room, key=lambda j: (room[j], -j)) if room else i % new
            if room.get(j, 0) >= size:
                plan.whole[i, b] = j
                room[j] -= size
            else:
                rest.append((b, size))
        for b, size in rest:
            shares = []
            for j in sorted(room, key=lambda j: (-room[j], j)):
                take = min(room[j], size)
                if take > 0:
                    shares.append((j, take))
                    room[j] -= take
                    size -= take
            if len(shares) == 1:
                plan.whole[i, b] = shares[0][0]
            elif shares:
                plan.split[i, b] = shares
            else:
                plan.whole[i, b] = i % new
    return plan


def text_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8


def text_crc(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def lay_out(docs: DataFrame, shard: Column, shards: int, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes docs as shards of blocks; shard: number of each row's shard (null counts as 0). Columns of docs that are named shard, old or blk get _of_document behind their names."""
    rows = docs.count()
    docs = docs.withColumn("_shard", shard).withColumnsRenamed({c: f"{c}_of_document" for c in docs.columns if c.lower() in ("shard", "old", "blk")})
    per_shard = max(1, min(-(-rows // (shards * BLOCK_ROWS)), MAX_BLOCKS // shards))
    blk = F.pmod(F.xxhash64(F.col(id_col).cast("string"), text_crc(F.col(text_col))), F.lit(per_shard)).cast("int")
    out = docs.withColumn("shard", F.coalesce(F.pmod("_shard", F.lit(shards)), F.lit(0)).cast("int")).drop("_shard").withColumn("old", F.col("shard")).withColumn("blk", blk)
    out.repartition(max(1, shards * per_shard), "old", "blk").write.partitionBy("shard", "old", "blk").parquet(path)


def _split_rows(shares: dict[str, list[tuple[int, int]]]):
    def run(t: pa.Table) -> pa.Table:
        """The largest document first to the shard that lacks most."""
        old, blk = t.column("old")[0].as_py(), t.column("blk")[0].as_py()
        heap = [(-x, j) for j, x in shares[f"{old}-{blk}"]]
        heapq.heapify(heap)
        rows = sorted(zip(t.column("key").to_pylist(), t.column("bytes").to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))
        to = []
        for _, size in rows:
            lack, j = heap[0]
            to.append(j)
            heapq.heapreplace(heap, (lack + size, j))
        return pa.table({"old": pa.array([old] * len(rows), pa.int32()), "blk": pa.array([blk] * len(rows), pa.int32()), "key": pa.array([k for k, _ in rows], pa.int64()), "to": pa.array(to, pa.int32())})

    return run


def _file_system(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    return hadoop, hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())


def _plan_file(path: str) -> str:
    return f"{path.rstrip('/')}-moves"


def _read_plan(spark: SparkSession, path: str) -> dict | None:
    hadoop, fs = _file_system(spark, path)
    if not fs.exists(hadoop.Path(_plan_file(path))):
        return None
    return json.loads(spark.read.text(_plan_file(path), wholetext=True).first()[0])


def _write_plan(spark: SparkSession, path: str, plan: dict) -> None:
    """Whole or not at all: written under another name, then renamed."""
    hadoop, fs = _file_system(spark, path)
    name = hadoop.Path(_plan_file(path) + "-new")
    out = fs.create(name, True)
    out.write(bytearray(json.dumps(plan).encode()))
    out.close()
    fs.delete(hadoop.Path(_plan_file(path)), True)
    if not fs.rename(name, hadoop.Path(_plan_file(path))):
        raise OSError(f"{name} can't be renamed")


def finish_moves(spark: SparkSession, path: str) -> bool:
    """Carries out the moves that the layout's plan file lists, and removes the file; if there is one. Each step can be repeated, so a driver that was lost in between is followed by another that calls this (reshard does)."""
    plan = _read_plan(spark, path)
    if plan is None:
        return False
    hadoop, fs = _file_system(spark, path)

    def move(step: tuple[str, str, bool]) -> None:
        a, b, replaces = step
        source, target = hadoop.Path(a), hadoop.Path(b)
        if fs.exists(source):  # else it was moved before
            if replaces:
                fs.delete(target, True)
            fs.mkdirs(target.getParent())
            if not fs.rename(source, target):
                raise OSError(f"{a} can't be renamed to {b}")

    with ThreadPoolExecutor(16) as pool:
        # the rows of a split block are all in the new pieces before it goes
        list(pool.map(lambda p: fs.delete(hadoop.Path(p), True), plan["gone"]))
        list(pool.map(move, ((a, b, False) for a, b in plan["whole"])))
        list(pool.map(move, ((a, b, True) for a, b in plan["pieces"])))
    if plan["aside"]:
        drop_path(spark, plan["aside"])
    fs.delete(hadoop.Path(_plan_file(path)), True)
    return True


def reshard(spark: SparkSession, path: str, old: int, new: int, id_col: str = "doc_id", text_col: str = "text") -> Plan:
    """Changes a layout of `old` shards into one of `new` shards with near equal bytes (text_size), in place; returns what it did.

    Split blocks are first written anew in a folder aside; then a plan file lists all moves; then they are made. A run that was lost while it moved is finished first; one lost before has changed nothing.
    """
    finish_moves(spark, path)
    df = spark.read.parquet(path)
    sizes = df.groupBy("old", "blk").agg(F.sum(text_size(F.col(text_col))).alias("size")).collect()
    plan = plan_blocks({(r["old"], r["blk"]): r["size"] for r in sizes}, old, new)
    folder = lambda shard, i, b, root=path: f"{root}/shard={shard}/old={i}/blk={b}"
    gone, pieces, aside = [], [], ""
    if plan.split:
        names = [f"{i}-{b}" for i, b in plan.split]
        part = df.where(F.concat(F.col("old"), F.lit("-"), F.col("blk")).isin(names))
        key = F.xxhash64(F.col(id_col).cast("string"), text_crc(F.col(text_col)), F.octet_length(text_col))
        shares = {f"{i}-{b}": x for (i, b), x in plan.split.items()}
        keyed = part.withColumn("palimp_key", key)
        once = keyed.select("old", "blk", F.col("palimp_key").alias("key"), text_size(F.col(text_col)).alias("bytes")).groupBy("old", "blk", "key").agg(F.sum("bytes").alias("bytes"))
        to = once.groupBy("old", "blk").applyInArrow(_split_rows(shares), "old int, blk int, key long, to int")
        to = to.select(F.col("old").alias("o2"), F.col("blk").alias("b2"), F.col("key").alias("k2"), "to")
        moved = keyed.join(to, (F.col("old") == F.col("o2")) & (F.col("blk") == F.col("b2")) & (F.col("palimp_key") == F.col("k2")))
        moved = moved.withColumn("shard", F.col("to")).drop("o2", "b2", "k2", "to", "palimp_key")
        aside = fresh_dir(spark, "moved")
        moved.repartition(max(1, len(names)), "old", "blk").write.partitionBy("shard", "old", "blk").parquet(aside)
        gone = [folder(i, i, b) for i, b in plan.split if i not in {j for j, _ in plan.split[i, b]}]
        pieces = [(folder(j, i, b, aside), folder(j, i, b)) for (i, b), x in plan.split.items() for j, _ in x]
    whole = [(folder(i, i, b), folder(j, i, b)) for (i, b), j in plan.whole.items() if i != j]
    _write_plan(spark, path, {"aside": aside, "gone": gone, "whole": whole, "pieces": pieces})
    finish_moves(spark, path)
    return plan


def numbered(spark: SparkSession, path: str, schema, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of a layout with slot: their number in the shard, without gaps, in the order of old shard, block and id. Blocks are numbered alone, and moved on by the rows of the blocks before."""
    df = spark.read.schema(schema).parquet(path).withColumn("crc", text_crc(F.col(text_col))).withColumn("size", text_size(F.col(text_col)))
    df = df.select(F.col(id_col).alias("doc_id"), "size", "crc", "shard", "old", "blk")
    pieces = df.groupBy("shard", "old", "blk").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("shard").orderBy("old", "blk").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("shard", "old", "blk", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    own = Window.partitionBy("shard", "old", "blk").orderBy("doc_id", "crc")
    return df.withColumn("n", F.row_number().over(own) - 1).join(F.broadcast(pieces), ["shard", "old", "blk"]).select("doc_id", "size", "crc", "shard", (F.col("start") + F.col("n")).cast("long").alias("slot"))


def shard_documents(docs: DataFrame, old: int, new: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, crc, shard, slot of each row after resharding from `old` shards, by id, to `new` ones with near equal bytes.

    The layout is written to the shared folder with id and text, resharded there, and read back. Null ids are in old shard 0, null texts have size 8 and the checksum of an empty text. Rows that
    repeat id and text stay in one shard. Ids must be whole numbers. An empty table gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    path = fresh_dir(spark, "layout")
    lay_out(base, F.col("doc_id"), old, path)
    schema = T.StructType([*base.schema.fields, *(T.StructField(c, T.IntegerType()) for c in ("shard", "old", "blk"))])
    if base.isEmpty():
        return spark.createDataFrame([], f"doc_id {base.schema['doc_id'].dataType.simpleString()}, size long, crc long, shard int, slot long")
    reshard(spark, path, old, new)
    return numbered(spark, path, schema)
