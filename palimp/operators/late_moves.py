"""Moves found after the comparison: blocks of equal content anywhere in both texts, and syntax nodes that changed place; and their effect on classified rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimp.functions.similarity import block_similarity
from palimp.functions.syntax import ast_nodes
from palimp.functions.text import lines_of, trimmed
from palimp.operators.matching import greedy_pairs

LARGEST, LEAST_CHARS, NODE_THRESHOLD = 10, 10, 0.85
COUNTS = ("total_changes", "added", "removed", "modified", "moved", "unchanged")
#: Characters of text that are compared at once.
HELD = 1 << 20
#: White space as the SQL knows it.
SPACES = " \t\n\f\r"


class _Side:
    """The lines of one side of some pairs, one pair after the other: what a window of lines holds is a difference of running sums. ids: a number for each text of a line within its pair, -1 for blank lines."""

    def __init__(self, ids: list[int], chars: list[int], sizes: list[int], numbers: list[int] | None):
        n = len(ids)
        self.ids, at = ids, np.arange(n)
        known = np.array(ids, np.int64)
        h = (known + 1).astype(np.uint64)
        # splitmix64, and 0 for blank lines
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ h >> np.uint64(shift)) * np.uint64(factor)
        h ^= h >> np.uint64(31)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h, dtype=np.uint64)])
        # a line with the line feed after it
        self.chars = np.concatenate([[0], np.cumsum(np.array(chars, np.int64) + 1)])
        self.last = np.maximum.accumulate(np.where(known >= 0, at, -1)) if n else at
        self.next = np.minimum.accumulate(np.where(known >= 0, at, n)[::-1])[::-1] if n else at
        first = np.cumsum([0, *sizes])
        self.end = np.repeat(first[1:], sizes)
        self.no = at - np.repeat(first[:-1], sizes) if numbers is None else np.array(numbers, np.int64)
        # places of lines of all pairs, with room for the largest window behind a pair's last line
        room = [int(self.no[e - 1]) + 1 + LARGEST if k else 0 for e, k in zip(first[1:], sizes, strict=True)]
        self.base = np.cumsum([0, *room])
        self.place = self.no + np.repeat(self.base[:-1], sizes)
        self.used = bytearray(int(self.base[-1]))

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First lines and sums of the windows with enough characters and no used line."""
        i = np.nonzero(np.arange(len(self.end)) + size <= self.end)[0]
        i = i[self.next[i] < i + size]
        i = i[self.chars[self.last[i + size - 1] + 1] - self.chars[self.next[i]] - 1 >= LEAST_CHARS]
        n = np.concatenate([[0], np.cumsum(np.frombuffer(self.used, np.int8), dtype=np.int64)])
        i = i[n[self.place[i] + size] == n[self.place[i]]]
        return i, self.sums[i + size] - self.sums[i]

    def content(self, i: int, size: int) -> tuple[int, ...]:
        """Of windows of one size, those with the same lines that aren't blank have as many blank ones."""
        return tuple(sorted(self.ids[i : i + size]))

    def free(self, place: int, size: int) -> bool:
        return self.used.find(1, place, place + size) < 0


def _take(pairs: list[tuple[list[str], list[str]]], numbers: tuple[list[list[int]], list[list[int]]] | None = None) -> tuple[list[tuple[int, int, int]], _Side, _Side]:
    """Moves (old line, new line, size) of all pairs, lines counted through all pairs, and both sides with their used lines. numbers: the lines' numbers, if they aren't 0, 1, 2 ...

    Larger windows first, then in the old order; each old window goes to the first free new one of the same content, unless that is where it was. Sums find the windows that may have a partner; their lines themselves decide.
    """
    ids, chars, next_id = ([], []), ([], []), 0
    for pair in pairs:
        known: dict[str, int] = {}
        for side, lines in enumerate(pair):
            texts = [x.strip(SPACES) for x in lines]
            chars[side].extend(map(len, texts))
            ids[side].extend([known.setdefault(t, next_id + len(known)) if t else -1 for t in texts])
        next_id += len(known)
    flat = [None, None] if numbers is None else [[n for x in side for n in x] for side in numbers]
    old, new = (_Side(ids[k], chars[k], [len(p[k]) for p in pairs], flat[k]) for k in (0, 1))
    out = []
    for size in range(LARGEST, 0, -1):
        (i, x), (j, y) = old.windows(size), new.windows(size)
        i, j = i[np.isin(x, y)], j[np.isin(y, x)]
        at: dict[tuple[int, ...], list[int]] = {}
        for w in j[::-1].tolist():
            at.setdefault(new.content(w, size), []).append(w)
        for w, place, no in zip(i.tolist(), old.place[i].tolist(), old.no[i].tolist(), strict=True):
            if not old.free(place, size):
                continue
            there = at.get(old.content(w, size))
            # windows with a used line never become free again
            while there and not new.free(int(new.place[there[-1]]), size):
                there.pop()
            if there and new.no[there[-1]] != no:
                to = int(new.place[there[-1]])
                out.append((w, there[-1], size))
                old.used[place : place + size] = new.used[to : to + size] = b"\1" * size
    return out, old, new


def _pieces(batch: pa.RecordBatch, chars: Callable[[int], int]) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of HELD characters or one pair."""
    start, size = 0, 0
    for k in range(batch.num_rows):
        size += chars(k)
        if size >= HELD or k + 1 == batch.num_rows:
            yield batch.slice(start, k + 1 - start)
            start, size = k + 1, 0


def content_moves(old: DataFrame, new: DataFrame) -> DataFrame:
    """pair_id, start_old, start_new, size of moved blocks of one to ten lines whose trimmed lines that aren't blank are the same in any order; blocks of less than ten characters don't move.

    The lines of a pair meet in one row; windows are made where they are compared, so lines are shuffled, not windows of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _pieces(batch, lambda k, b=batch: sum(len(x["line"]) for c in (1, 2) for x in b.column(c)[k].as_py())):
                sides = [[sorted((x["line_no"], x["line"]) for x in row) for row in part.column(c).to_pylist()] for c in (1, 2)]
                pairs = [tuple([t for _, t in side[k]] for side in sides) for k in range(part.num_rows)]
                moves, a, b = _take(pairs, tuple([[n for n, _ in row] for row in side] for side in sides))
                i, j, n = np.array(moves, np.int64).reshape(-1, 3).T
                of = np.repeat(np.arange(part.num_rows), [len(p[0]) for p in pairs])
                columns = [pa.array(v, pa.int32()) for v in (a.no[i], b.no[j], n)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of[i], pa.int64())), *columns], names=["pair_id", "start_old", "start_new", "size"])

    lines = lambda df, name: df.where("line is not null").groupBy("pair_id").agg(F.collect_list(F.struct("line_no", "line")).alias(name))
    kind = old.schema["pair_id"].dataType.simpleString()
    return lines(old, "a").join(lines(new, "b"), "pair_id").select("pair_id", "a", "b").mapInArrow(run, f"pair_id {kind}, start_old int, start_new int, size int")


def positional_stats(pairs: DataFrame) -> DataFrame:
    """pair_id, total_changes, added, removed, modified, moved, unchanged of pairs (pair_id, old_text, new_text; null texts are empty) in the degraded comparison by number, after the late moves of content; without a shuffle.

    Lines of one number are unchanged or modified, so lines beyond the shorter text's are what is removed or added, and what may have moved. The rows are those of stats, apply_moves and classify_fast on tables of lines.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _pieces(batch, lambda k, b=batch: sum(len(b.column(c)[k].as_py()) for c in (1, 2))):
                both = [tuple(t.split("\n") for t in texts) for texts in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                _, old, new = _take(both)
                rows = []
                for k, (a, b) in enumerate(both):
                    n, m = len(a), len(b)
                    same = sum(map(str.__eq__, a, b))
                    gone, come = (side.used.count(1, int(side.base[k]) + min(n, m), int(side.base[k]) + most) for side, most in ((old, n), (new, m)))
                    rows.append((max(n, m), max(m - n, 0) - come, max(n - m, 0) - gone, min(n, m) - same, gone + come, same))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(v, pa.int64()) for v in zip(*rows, strict=True))], names=["pair_id", *COUNTS])

    x = pairs.select("pair_id", *(F.coalesce(c, F.lit("")).alias(c) for c in ("old_text", "new_text")))
    return x.mapInArrow(run, f"pair_id {x.schema['pair_id'].dataType.simpleString()}, {', '.join(f'{c} long' for c in COUNTS)}")


def text_nodes(texts: DataFrame, id_col: str = "pair_id", text_col: str = "text") -> DataFrame:
    """pair_id, type, start_line (from 0), end_line, content of the definitions and statements of parseable texts."""
    n = texts.select(F.col(id_col).alias("pair_id"), F.explode(ast_nodes(text_col)).alias("n"))
    return n.select("pair_id", "n.type", (F.col("n.start_line") - 1).alias("start_line"), (F.col("n.end_line") - 1).alias("end_line"), "n.content")


def node_moves(old: DataFrame, new: DataFrame, threshold: float = NODE_THRESHOLD) -> DataFrame:
    """pair_id, type, old_start, old_end, new_start, new_end, similarity, kind of nodes that changed place.

    Equal ones first, where the new content is unique (moved); then similar ones of the same type, the most similar first (moved-modified). Only nodes that share a line are compared.
    """
    key = ["pair_id", "type", "content"]
    a = old.select(*key, F.col("start_line").alias("old_start"), F.col("end_line").alias("old_end"))
    b = new.select(*key, F.col("start_line").alias("new_start"), F.col("end_line").alias("new_end"))
    single = b.groupBy(*key).agg(F.count("*").alias("n"), F.min("new_start").alias("new_start"), F.min("new_end").alias("new_end")).where("n = 1").drop("n")
    same = a.join(single, key).where("old_start != new_start").withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy("old_start"))).where("k = 1")
    same = same.select("pair_id", "type", "old_start", "old_end", "new_start", "new_end", F.lit(1.0).alias("similarity"), F.lit("moved").alias("kind"))
    a = a.join(same.select("pair_id", "type", "old_start"), ["pair_id", "type", "old_start"], "left_anti")
    b = b.join(same.select("pair_id", "type", "new_start"), ["pair_id", "type", "new_start"], "left_anti")
    line = F.explode(F.array_distinct(F.filter(F.transform(lines_of(F.col("content")), trimmed), lambda v: v != "")))
    near = a.select("pair_id", "type", "old_start", line.alias("line")).join(b.select("pair_id", "type", "new_start", line.alias("line")), ["pair_id", "type", "line"])
    near = near.select("pair_id", "type", "old_start", "new_start").distinct()
    near = near.join(a.withColumnRenamed("content", "x"), ["pair_id", "type", "old_start"]).join(b.withColumnRenamed("content", "y"), ["pair_id", "type", "new_start"])
    scored = near.withColumn("sim", block_similarity(F.col("x"), F.col("y"))).where(F.col("sim") > threshold).withColumnsRenamed({"old_start": "old_no", "new_start": "new_no"})
    best = greedy_pairs(scored, threshold, ("pair_id", "type")).where("old_no != new_no").withColumnsRenamed({"old_no": "old_start", "new_no": "new_start"})
    best = best.join(a.drop("content"), ["pair_id", "type", "old_start"]).join(b.drop("content"), ["pair_id", "type", "new_start"])
    return same.unionByName(best.select("pair_id", "type", "old_start", "old_end", "new_start", "new_end", F.col("sim").alias("similarity"), F.lit("moved-modified").alias("kind")))


def as_ranges(moves: DataFrame) -> DataFrame:
    """Moves of content as ranges of lines: pair_id, old_start, old_end, new_start, new_end, kind."""
    return moves.select("pair_id", F.col("start_old").alias("old_start"), (F.col("start_old") + F.col("size") - 1).alias("old_end"), F.col("start_new").alias("new_start"), (F.col("start_new") + F.col("size") - 1).alias("new_end"), F.lit("moved").alias("kind"))


def late_moves(pairs: DataFrame) -> DataFrame:
    """Moves of content and of syntax nodes of pairs (pair_id, old_text, new_text), as ranges of lines."""
    lines = lambda c: pairs.select("pair_id", F.posexplode(lines_of(F.coalesce(c, F.lit("")))).alias("line_no", "line"))
    nodes = node_moves(text_nodes(pairs, text_col="old_text"), text_nodes(pairs, text_col="new_text"))
    return as_ranges(content_moves(lines("old_text"), lines("new_text"))).unionByName(nodes.select("pair_id", "old_start", "old_end", "new_start", "new_end", "kind"))


def apply_moves(rows: DataFrame, moves: DataFrame) -> DataFrame:
    """Classified rows in which removed and added lines inside moves (pair_id, old_start, old_end, new_start, new_end, kind) have the kind of the move; moved comes before moved-modified."""

    def lines(side: str) -> DataFrame:
        x = moves.select("pair_id", F.explode(F.sequence(f"{side}_start", f"{side}_end")).alias(f"{side}_no"), "kind")
        return x.groupBy("pair_id", f"{side}_no").agg(F.min("kind").alias(f"{side}_kind"))

    x = rows.join(lines("old"), ["pair_id", "old_no"], "left").join(lines("new"), ["pair_id", "new_no"], "left")
    c = F.col("classification")
    kind = F.when((c == "removed") & F.col("old_kind").isNotNull(), F.col("old_kind")).when((c == "added") & F.col("new_kind").isNotNull(), F.col("new_kind")).otherwise(c)
    return x.withColumn("classification", kind).select(*rows.columns)
