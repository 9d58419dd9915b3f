"""Comment and string regions inside a line, and the changes inside them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .edit import value_script

_DOUBLE, _SINGLE = ('"', '"', True), ("'", "'", True)
_TRIPLE = ('"""', '"""', False), ("'''", "'''", False)
#: Line comments, block comments and strings (start, end, escapes) by family of syntax.
SYNTAX = {
    "c": (("//",), (("/*", "*/"),), (_DOUBLE, _SINGLE)), "python": (("#",), (), (*_TRIPLE, _DOUBLE, _SINGLE)), "shell": (("#",), (), (_DOUBLE, ("'", "'", False))),
    "sql": (("--",), (("/*", "*/"),), (_SINGLE,)), "html": ((), (("<!--", "-->"),), (_DOUBLE, _SINGLE)), "ruby": (("#",), (("=begin", "=end"),), (_DOUBLE, _SINGLE)),
    "php": (("//", "#"), (("/*", "*/"),), (_DOUBLE, _SINGLE)), "go": (("//",), (("/*", "*/"),), (_DOUBLE, _SINGLE, ("`", "`", False))), "swift": (("//",), (("/*", "*/"),), (_TRIPLE[0], _DOUBLE, _SINGLE)),
    "haskell": (("--",), (("{-", "-}"),), (_DOUBLE,)), "lua": (("--",), (("--[[", "]]"),), (_DOUBLE, _SINGLE, ("[[", "]]", False))), "perl": (("#",), (), (_DOUBLE, _SINGLE, ("`", "`", True))),
    "json": ((), (), (_DOUBLE,)), "ini": ((";", "#"), (), (_DOUBLE, _SINGLE)), "properties": (("#", "!"), (), (_DOUBLE,)), "hash": (("#",), (), (_DOUBLE, _SINGLE)),
    "default": (("//", "#", "--"), (("/*", "*/"), ("<!--", "-->")), (_DOUBLE, _SINGLE)),
}
#: Languages of each family.
FAMILIES = {
    "c": ("c", "css", "rust", "js", "javascript", "typescript", "ts", "java", "cpp", "c++", "c#", "cs"),
    "python": ("python", "py", "toml"),
    "shell": ("shell", "bash", "sh", "zsh"),
    "html": ("html", "xml", "svg"),
    "ruby": ("ruby", "rb"),
    "swift": ("swift", "kotlin", "kt", "scala"),
    "haskell": ("haskell", "hs"),
    "perl": ("perl", "pl"),
    "hash": ("r", "dockerfile", "docker", "yaml", "makefile"),
}
_FAMILY = {name: family for family, names in FAMILIES.items() for name in names}


def syntax_of(language: str | None) -> tuple:
    name = (language or "").lower().strip()
    if not name:
        return SYNTAX["default"]
    if name in _FAMILY or name in SYNTAX:
        return SYNTAX[_FAMILY.get(name, name)]
    for part, family in (("c", "c"), ("script", "c"), ("py", "python"), ("sql", "sql"), ("html", "html"), ("xml", "html")):
        if part in name:
            return SYNTAX[family]
    return SYNTAX["default"]


def regions_of(line: str, language: str | None = None) -> list[dict]:
    """Strings first, then line comments, then block comments; an unclosed block comment runs to the end, an unclosed string is none."""
    line_marks, blocks, strings = syntax_of(language)
    out, i = [], 0
    while i < len(line):
        end, kind = -1, ""
        for a, b, escapes in strings:
            if line.startswith(a, i):
                j = i + len(a)
                while j < len(line) and not line.startswith(b, j):
                    j += 2 if escapes and line[j] == "\\" else 1
                if j < len(line):
                    end, kind = j + len(b), "string"
                    break
        if end < 0 and any(line.startswith(m, i) for m in line_marks) and not any(line.startswith(a, i) and len(a) > 2 for a, _ in blocks):
            end, kind = len(line), "comment"
        if end < 0:
            for a, b in blocks:
                if line.startswith(a, i):
                    j = line.find(b, i + len(a))
                    end, kind = (j + len(b) if j >= 0 else len(line)), "comment"
                    break
        if end < 0:
            i += 1
        else:
            out.append({"type": kind, "start": i, "end": end, "content": line[i:end]})
            i = end
    return out


def nested_changes(a: str, b: str, language: str | None = None) -> list[dict]:
    """Regions of equal type, in order, that differ; one without a partner is removed or added whole."""
    out = []
    for kind in ("comment", "string"):
        x, y = ([r["content"] for r in regions_of(t, language) if r["type"] == kind] for t in (a, b))
        for i in range(max(len(x), len(y))):
            p, q = x[i] if i < len(x) else None, y[i] if i < len(y) else None
            if p != q:
                out.append({"type": kind, "removed": p, "added": q, "word_diff": value_script(p or "", q or "")})
    return out


def with_code(found: Column, line: Column) -> Column:
    """The regions of a line with the gaps between them as code, in order."""
    n = F.size(found)

    def gap(i: Column) -> Column:
        a = F.when(i == 0, 0).otherwise(F.element_at(found, F.greatest(i, F.lit(1)))["end"])
        b = F.when(i == n, F.length(line)).otherwise(F.element_at(found, F.least(i, n - 1) + 1)["start"])
        return F.struct(F.lit("code").alias("type"), a.alias("start"), b.alias("end"), line.substr(a + 1, b - a).alias("content"))

    def order(x: Column, y: Column) -> Column:
        return x["start"] - y["start"]

    gaps = F.when(n == 0, F.array(F.struct(F.lit("code").alias("type"), F.lit(0).alias("start"), F.length(line).alias("end"), line.alias("content")))).otherwise(F.transform(F.sequence(F.lit(0), n), gap))
    return F.array_sort(F.concat(found, F.filter(gaps, lambda g: g["start"] < g["end"])), order)


def region_type_at(found: Column, place: Column) -> Column:
    """Type of the region that holds the position (from 0); code where none does."""
    return F.coalesce(F.try_element_at(F.filter(found, lambda r: (r["start"] <= place) & (place < r["end"])), F.lit(1))["type"], F.lit("code"))


def without_comments(found: Column, line: Column) -> Column:
    """The line without its comment regions."""
    return F.array_join(F.transform(F.filter(with_code(found, line), lambda r: r["type"] != "comment"), lambda r: r["content"]), "")


REGIONS = T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("content", T.StringType())]))
_REGIONS = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("content", pa.string())]))
NESTED = T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("removed", T.StringType()), T.StructField("added", T.StringType()), T.StructField("word_diff", T.ArrayType(T.StructType([T.StructField("op", T.StringType()), T.StructField("value", T.StringType())])))]))
_NESTED = pa.list_(pa.struct([("type", pa.string()), ("removed", pa.string()), ("added", pa.string()), ("word_diff", pa.list_(pa.struct([("op", pa.string()), ("value", pa.string())])))]))


@F.arrow_udf(REGIONS)
def regions(x: pa.Array, language: pa.Array) -> pa.Array:
    return pa.array([None if t is None else regions_of(t, k) for t, k in zip(x.to_pylist(), language.to_pylist(), strict=True)], _REGIONS)


@F.arrow_udf(NESTED)
def nested_diffs(a: pa.Array, b: pa.Array, language: pa.Array) -> pa.Array:
    return pa.array([None if x is None or y is None else nested_changes(x, y, k) for x, y, k in zip(a.to_pylist(), b.to_pylist(), language.to_pylist(), strict=True)], _NESTED)
