"""Similarity by syntax trees. Trees come from Python's own parser for Python lines; other languages have none here, and give null."""

from __future__ import annotations

import ast
import json

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEPTH, FAN, ACCEPT, ROOT, STRUCTURE = 3, 20, 0.7, 0.4, 0.6


def signature(node: ast.AST, depth: int = 0) -> dict:
    """Types of a node and of its children, DEPTH levels, FAN children."""
    kids = [] if depth >= DEPTH else [signature(c, depth + 1) for c in list(ast.iter_child_nodes(node))[:FAN] if not isinstance(c, (ast.Load, ast.Store))]
    return {"type": type(node).__name__, "children": kids}


def serialize(s: dict) -> str:
    return s["type"] + (f"({','.join(map(serialize, s['children']))})" if s["children"] else "")


def parse(line: str) -> dict | None:
    try:
        return signature(ast.parse(line.strip()))
    except (SyntaxError, ValueError, MemoryError, RecursionError):
        return None


def compare_structures(a: dict, b: dict) -> float:
    """Equal types; children matched greedily, each to its best partner above ACCEPT."""
    same = 1.0 if a["type"] == b["type"] else 0.0
    x, y = a["children"], b["children"]
    if not x and not y:
        return same
    left, total = list(range(len(y))), 0.0
    for c in x:
        best = max(((compare_structures(c, y[j]), -j) for j in left), default=(0.0, 0))
        if best[0] > ACCEPT:
            total += best[0]
            left.remove(-best[1])
    return (same + total / max(len(x), len(y))) / 2


def tree_similarity(a: str, b: str) -> float | None:
    x, y = parse(a), parse(b)
    if x is None or y is None:
        return None
    return ROOT * (x["type"] == y["type"]) + STRUCTURE * compare_structures(x, y)


def nodes_of(text: str) -> list[dict]:
    """Named definitions and statements of a text with their lines."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, MemoryError, RecursionError):
        return []
    kinds = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Import, ast.ImportFrom, ast.If, ast.For, ast.While, ast.Try, ast.With)
    return [{"type": type(n).__name__, "start_line": n.lineno, "end_line": n.end_lineno or n.lineno, "content": ast.unparse(n)} for n in ast.walk(tree) if isinstance(n, kinds)]


@F.arrow_udf(T.DoubleType())
def ast_similarity(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([None if x is None or y is None else tree_similarity(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())


@F.arrow_udf(T.StringType())
def ast_signature(x: pa.Array) -> pa.Array:
    return pa.array([None if t is None or (s := parse(t)) is None else serialize(s) for t in x.to_pylist()], pa.string())


NODES = T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("start_line", T.IntegerType()), T.StructField("end_line", T.IntegerType()), T.StructField("content", T.StringType())]))


@F.arrow_udf(NODES)
def ast_nodes(x: pa.Array) -> pa.Array:
    return pa.array([None if t is None else nodes_of(t) for t in x.to_pylist()], pa.list_(pa.struct([("type", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("content", pa.string())])))


def full_similarity(token_or_word, tree, weight: float = 0.6):
    """The weighted mean with the tree's similarity, where there is one."""
    return F.coalesce(weight * tree + (1 - weight) * token_or_word, token_or_word)


def strict_json(text: str) -> bool:
    def reject(x):
        raise ValueError(x)

    try:
        json.loads(text, parse_constant=reject)
    except ValueError:
        return False
    return True
