"""Text normalisation and guards as column expressions; what needs a scanner is an Arrow UDF."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAIRS = ("()", "[]", "{}", "<>")
#: Delimiter pairs by language.
LANGUAGE_PAIRS = {
    "python": (("(", ")"), ("[", "]"), ("{", "}"), ("<", ">")), "javascript": (("(", ")"), ("[", "]"), ("{", "}"), ("<", ">"), ("${", "}")),
    "html": (("<", ">"), ("<!--", "-->")), "css": (("(", ")"), ("[", "]"), ("{", "}")), "json": (("[", "]"), ("{", "}")),
}


def trimmed(c: Column) -> Column:
    """Without white space at either end (all of it, not only spaces)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def normal_form(c: Column) -> Column:
    return F.lower(trimmed(c))


def bound(value: Column, f) -> Column:
    """f of a value that is computed once, however often f's result uses it, also inside other functions of elements."""
    return F.element_at(F.transform(F.array(value), f), 1)


def lines_of(c: Column) -> Column:
    return F.split(c, "\n", -1)


def normalize_whitespace(c: Column) -> Column:
    """Lines trimmed, inner white space collapsed to a space, empty lines dropped."""
    each = F.transform(lines_of(c), lambda x: F.regexp_replace(trimmed(x), r"\s+", " "))
    return F.array_join(F.filter(each, lambda x: x != ""), "\n")


def looks_binary(c: Column) -> Column:
    """A character outside printable ASCII and white space among the first 1000."""
    return F.substring(c, 1, 1000).rlike(r"[^\x20-\x7E\s]")


def too_large(c: Column, limit: int = 5 << 20) -> Column:
    return F.octet_length(c) > limit


def count_delimiters(c: Column, mark: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(mark), F.lit("")))


def squeeze_delimiters(c: Column) -> Column:
    """White space around brackets removed, for all pairs."""
    for mark in "".join(PAIRS):
        c = F.regexp_replace(c, rf"\s*\{mark}\s*", re.escape(mark) if mark != "$" else mark)
    return c


def squeeze_html_comments(c: Column) -> Column:
    return F.regexp_replace(c, r"<!--\s+([\s\S]*?)\s+-->", "<!--$1-->")


def _pairs_of(language: str | None) -> list[tuple[str, str]]:
    return list(LANGUAGE_PAIRS.get((language or "").lower(), LANGUAGE_PAIRS["python"]))


def _escaped(text: str, at: int) -> bool:
    n = 0
    while at - n - 1 >= 0 and text[at - n - 1] == "\\":
        n += 1
    return n % 2 == 1


def _inner_spans(text: str, open_: str, close: str) -> list[tuple[int, int]]:
    """Contents of the balanced top-level pairs."""
    out, depth, start, i = [], 0, 0, 0
    while i < len(text):
        if text.startswith(open_, i) and not _escaped(text, i):
            depth += 1
            i += len(open_)
            if depth == 1:
                start = i
        elif depth and text.startswith(close, i) and not _escaped(text, i):
            depth -= 1
            if not depth:
                out.append((start, i))
            i += len(close)
        else:
            i += 1
    return out


def normalize_delimiters_text(text: str | None, language: str | None = None) -> str | None:
    """The full normalisation of one text. The contents of the first balanced pair of each kind are collapsed; that is where later passes start again, so further pairs of the kind keep theirs."""
    if not text:
        return text
    for mark in "".join(PAIRS):
        text = re.sub(rf"\s*\{mark}\s*", lambda m, mark=mark: mark, text)
    for a, b in _pairs_of(language):
        if a == "<!--":
            text = re.sub(r"<!--\s+([\s\S]*?)\s+-->", lambda m: f"<!--{' '.join(m[1].split())}-->", text)
            continue
        text = re.sub(re.escape(a) + r"\s+", lambda m, a=a: a, text)
        text = re.sub(r"\s+" + re.escape(b), lambda m, b=b: b, text)
        if (a, b) in (("(", ")"), ("[", "]"), ("{", "}")):
            for lo, hi in _inner_spans(text, a, b)[:1]:
                text = text[:lo] + " ".join(text[lo:hi].split()) + text[hi:]
    return text


def delimiter_errors(text: str | None, language: str | None = None) -> list[dict]:
    """Unexpected closers and unclosed openers with their positions."""
    stack: list[tuple[str, int, str]] = []
    out = []
    i, pairs = 0, list(dict.fromkeys(_pairs_of(language)))
    while text and i < len(text):
        step = 1
        for a, b in pairs:
            if text.startswith(a, i) and not _escaped(text, i):
                stack.append((a, i, b))
                step = len(a)
                break
            if text.startswith(b, i) and not _escaped(text, i):
                if stack and stack[-1][0] == a:
                    stack.pop()
                else:
                    out.append({"type": "unexpected_close", "delimiter": b, "position": i, "expected": stack[-1][2] if stack else None})
                step = len(b)
                break
        i += step
    return out + [{"type": "unclosed", "delimiter": a, "position": at, "expected": b} for a, at, b in stack]


def _in_string(text: str, at: int) -> bool:
    quote = ""
    i = 0
    while i < at:
        if text[i] == "\\":
            i += 2
            continue
        if quote:
            quote = "" if text[i] == quote else quote
        elif text[i] in "'\"":
            quote = text[i]
        i += 1
    return bool(quote)


def strip_comments_text(text: str | None) -> str | None:
    """Line by line: from the first // on, from an unquoted # on, from an unquoted -- on, then closed block comments; in this order."""
    if not text:
        return text
    out = []
    for line in text.split("\n"):
        line = line.split("//", 1)[0]
        for mark in ("#", "--"):
            at = line.find(mark)
            if at >= 0 and not _in_string(line, at):
                line = line[:at]
        line = re.sub(r"/\*.*?\*/", "", line)
        out.append(re.sub(r"<!--.*?-->", "", line))
    return "\n".join(out)


_ERRORS = T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("delimiter", T.StringType()), T.StructField("position", T.IntegerType()), T.StructField("expected", T.StringType())]))
_ERRORS_ARROW = pa.list_(pa.struct([("type", pa.string()), ("delimiter", pa.string()), ("position", pa.int32()), ("expected", pa.string())]))


@F.arrow_udf(T.StringType())
def strip_comments(x: pa.Array) -> pa.Array:
    return pa.array([strip_comments_text(t) for t in x.to_pylist()], pa.string())


@F.arrow_udf(_ERRORS)
def _errors(x: pa.Array, language: pa.Array) -> pa.Array:
    return pa.array([delimiter_errors(t, k) for t, k in zip(x.to_pylist(), language.to_pylist(), strict=True)], _ERRORS_ARROW)


@F.arrow_udf(T.StringType())
def _normalized(x: pa.Array, language: pa.Array) -> pa.Array:
    return pa.array([normalize_delimiters_text(t, k) for t, k in zip(x.to_pylist(), language.to_pylist(), strict=True)], pa.string())


def validate_delimiters(c: str | Column, language: str | Column | None = None) -> Column:
    """Unexpected closers and unclosed openers of the pairs of a language (a name, or a column of names); empty if all are balanced."""
    return _errors(c, language if isinstance(language, Column) else F.lit(language).cast("string"))


def normalize_delimiters(c: str | Column, language: str | Column | None = None) -> Column:
    """The full normalisation with the pairs of a language (a name, or a column of names)."""
    return _normalized(c, language if isinstance(language, Column) else F.lit(language).cast("string"))


def normalize_with_state(c: Column, language: str | Column | None = None) -> Column:
    """The normalised text next to the original, which takes the place of a state for reversal."""
    return F.struct(normalize_delimiters(c, language).alias("normalized"), c.alias("original"))


def first_line_like(lines: Column, target: Column) -> Column:
    """Number (from 0) of the first line that equals the trimmed target, holds it, or is held by it and less than 10 characters shorter; the last two for targets of more than 3 characters. -1 if there is none."""
    t = trimmed(target)
    fits = lambda v: (v == t) | ((F.length(t) > 3) & (F.contains(v, t) | (F.contains(t, v) & (F.abs(F.length(t) - F.length(v)) < 10))))
    return F.array_position(F.transform(lines, lambda v: F.coalesce(fits(trimmed(v)), F.lit(False))), True) - 1
