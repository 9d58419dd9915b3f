"""The comparison of a pair in one go: edit script, change blocks, moved blocks, pairing, moves and what is left, a task for each batch of pairs, without a shuffle.

The rows are those of plans.compare.classify, which works on tables of lines. A pair's work is bounded: beyond the options' limits on lines and combinations of changed lines it takes the degraded mode, which is linear after the script.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimp.config import Options
from palimp.functions.edit import script_of, word_similarities
from palimp.functions.signature import form_signature
from palimp.functions.similarity import EPSILON, SHORT
from palimp.functions.syntax import tree_similarity
from palimp.functions.text import lines_of, normal_form
from palimp.functions.tokens import compare_tokens

ROWS = pa.schema([("seq", pa.int32()), ("classification", pa.string()), ("old_no", pa.int32()), ("new_no", pa.int32()), ("removed_line", pa.string()), ("added_line", pa.string()), ("similarity", pa.float64())])
#: Rows that are returned at once; combinations of signatures that are compared at once.
HELD, CELLS = 20_000, 1 << 20
SPACES = " \t\n\x0b\f\r"
_BITS = np.array([bin(i).count("1") for i in range(1 << 16)], np.int8)


def greedy(scored: list[tuple[float, int, int]]) -> list[tuple[int, int, float]]:
    """old_no, new_no, similarity: the highest similarity first, ties by old_no, then new_no, each line once."""
    old, new, out = set(), set(), []
    for far, i, j in sorted(scored):
        if i not in old and j not in new:
            old.add(i)
            new.add(j)
            out.append((i, j, -far))
    return out


def moved_blocks(removed: list[int], added: list[int], a: list[str], b: list[str], options: Options) -> list[tuple[int, int, int]]:
    """Runs of two or more removed lines that were added in the same order: the longest first, without overlap."""
    where = defaultdict(list)
    for j in added:
        where[b[j]].append(j)
    on = defaultdict(list)
    for i in removed:
        for j in where.get(a[i], ()):
            on[i - j].append(i)
    runs = []
    for d, at in on.items():
        start = at[0]
        for k, i in enumerate(at):
            if k + 1 == len(at) or at[k + 1] != i + 1:
                n = i - start + 1
                runs += [(-min(options.max_block, n - o), start + o, start + o - d) for o in range(0, n, options.max_block)]
                start = at[k + 1] if k + 1 < len(at) else 0
    old, new, out = set(), set(), []
    for n, i, j in sorted(runs):
        x, y = range(i, i - n), range(j, j - n)
        if n > -2 or len(out) == options.max_blocks:
            break
        if old.isdisjoint(x) and new.isdisjoint(y):
            old.update(x)
            new.update(y)
            out.append((i, j, -n))
    return out


def signature_similarities(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    z = x[:, None] ^ y[None, :]
    return 1 - (_BITS[z & 0xFFFF].astype(np.int16) + _BITS[z >> 16 & 0xFFFF]) / 32


def line_similarities(old: list[str], new: list[str], options: Options) -> list[float]:
    out = word_similarities(old, new)
    if options.use_tokens:
        out = [options.token_weight * compare_tokens(x, y)["similarity"] + (1 - options.token_weight) * s for x, y, s in zip(old, new, out, strict=True)]
    if options.language == "python":
        trees = [tree_similarity(x, y) for x, y in zip(old, new, strict=True)]
        out = [s if t is None else options.ast_weight * t + (1 - options.ast_weight) * s for s, t in zip(out, trees, strict=True)]
    return out


def pair_block(old: list[int], new: list[int], a: list[str], b: list[str], siga: np.ndarray, sigb: np.ndarray, options: Options) -> list[tuple[int, int, float]]:
    """Pairs of removed and added lines of one block: equal ones, then by words; lines whose signatures differ too much have half their signatures' similarity."""
    scored, ask = [], []
    step = max(1, CELLS // max(1, len(new)))
    for k in range(0, len(old), step):
        part = old[k : k + step]
        s = signature_similarities(siga[part], sigb[new])
        near = s >= options.fast_threshold
        if 0.5 * options.fast_threshold >= options.modified_threshold:
            scored += [(-0.5 * float(s[p, q]), part[p], new[q]) for p, q in zip(*np.nonzero(~near & (0.5 * s >= options.modified_threshold)), strict=True) if a[part[p]] != b[new[q]]]
        for p, q in zip(*(v.tolist() for v in np.nonzero(near)), strict=True):
            if a[part[p]] != b[new[q]]:
                ask.append((part[p], new[q]))
    same = defaultdict(list)
    for j in new:
        same[b[j]].append(j)
    scored += [(-1.0, i, j) for i in old for j in same.get(a[i], ())]
    if ask and not options.use_tokens and options.language != "python":
        ask = [(i, j) for i, j in ask if _may(a[i], b[j], options.modified_threshold)]
    sims = line_similarities([a[i] for i, _ in ask], [b[j] for _, j in ask], options)
    scored += [(-s, i, j) for (i, j), s in zip(ask, sims, strict=True) if s >= options.modified_threshold]
    return greedy(scored)


def _may(x: str, y: str, least: float) -> bool:
    """If the lengths allow a similarity of `least`: the characters in common are all of x at most, or those of y that are no white space and x's white space."""
    n, m = len(x.strip()), len(y.strip())
    return 2 * (min(n, len("".join(y.split())) + n - len("".join(x.split()))) + 2) >= least * (n + m)


def similar_lines(old: list[int], new: list[int], fa: list[str], fb: list[str], least: float) -> list[tuple[int, int, float]]:
    """Pairs of similar lines of normal forms fa and fb, wherever they are."""
    bags = {}
    for form in {fa[i] for i in old} | {fb[j] for j in new}:
        words = [w for w in form.translate(_TO_SPACE).split(" ") if w]
        bags[form] = words, set(words)
    scored = []
    for i in old:
        x = fa[i]
        words, seen = bags[x]
        for j in new:
            y = fb[j]
            if x == y:
                s = 1.0
            elif len(x) < SHORT and len(y) < SHORT:
                longest = max(len(x), len(y))
                if min(len(x), len(y)) / longest + EPSILON < least:
                    continue
                s = min(sum(map(str.__eq__, x, y)) / longest + EPSILON, 1.0)
            else:
                other = bags[y]
                if seen.isdisjoint(other[1]):
                    continue
                s = min(2 * sum(w in seen for w in other[0]) / max(len(words) + len(other[0]), 1) + EPSILON, 1.0)
            if s >= least:
                scored.append((-s, i, j))
    return greedy(scored)


_TO_SPACE = str.maketrans({c: " " for c in SPACES})


def compare_lines(a: list[str], b: list[str], fa: list[str], fb: list[str], siga: np.ndarray, sigb: np.ndarray, options: Options) -> list[tuple]:
    """Rows (seq, classification, old_no, new_no, removed line, added line, similarity) of two texts' lines; fa, fb: normal forms; siga, sigb: signatures."""
    script = script_of(a, b)
    out, seq_old, seq_new, block_old, block_new, block = [], {}, {}, {}, {}, 0
    blocks: dict[int, tuple[list[int], list[int]]] = {}
    for seq, (op, i, j) in enumerate(script):
        if op == "=":
            out.append((seq, "unchanged", i, j, a[i], a[i], 1.0))
            block += 1
        elif op == "-":
            seq_old[i], block_old[i] = seq, block
            blocks.setdefault(block, ([], []))[0].append(i)
        else:
            seq_new[j], block_new[j] = seq, block
            blocks.setdefault(block, ([], []))[1].append(j)
    lines = len(a) + len(b)
    if lines > options.max_lines_for_ast and options.language == "python":
        options = replace(options, language=None)
    if options.fast_mode and (lines > options.max_lines or len(seq_old) * len(seq_new) > options.max_pairs):
        for old, new in blocks.values():
            for k in range(max(len(old), len(new))):
                i, j = old[k] if k < len(old) else None, new[k] if k < len(new) else None
                kind = "added" if i is None else "removed" if j is None else "modified"
                out.append((seq_new[j] if i is None else seq_old[i], kind, i, j, None if i is None else a[i], None if j is None else b[j], None))
        return out
    left_old, left_new = dict.fromkeys(seq_old), dict.fromkeys(seq_new)

    def take(pairs: list[tuple[int, int, float]], kind) -> None:
        for i, j, s in pairs:
            del left_old[i], left_new[j]
            out.append((min(seq_old[i], seq_new[j]), kind(s), i, j, a[i], b[j], s))

    if options.detect_moves:
        moved = moved_blocks([i for i in left_old if fa[i]], [j for j in left_new if fb[j]], a, b, options)
        take([(i + k, j + k, 1.0) for i, j, n in moved for k in range(n)], lambda s: "block-moved")
    for old, new in blocks.values():
        old, new = [i for i in old if i in left_old], [j for j in new if j in left_new]
        if old and new:
            take(pair_block(old, new, a, b, siga, sigb, options), lambda s: "modified")
    if options.detect_moves:
        there = defaultdict(list)
        for j in left_new:
            there[b[j]].append(j)
        seen: dict[str, int] = defaultdict(int)
        exact = []
        for i in left_old:
            if fa[i]:
                k = seen[a[i]]
                seen[a[i]] += 1
                if k < len(there[a[i]]) and block_old[i] != block_new[there[a[i]][k]]:
                    exact.append((i, there[a[i]][k], 1.0))
        take(exact, lambda s: "moved")
        alike = similar_lines([i for i in left_old if fa[i]], [j for j in left_new if fb[j]], fa, fb, min(options.move_threshold, options.modified_threshold))
        take(alike, lambda s: "moved" if s >= options.move_threshold else "modified")
    out += [(seq_old[i], "removed", i, None, a[i], None, None) for i in left_old]
    out += [(seq_new[j], "added", None, j, None, b[j], None) for j in left_new]
    return out


def compare_pairs(pairs: DataFrame, options: Options) -> DataFrame:
    """pair_id, seq, classification, old_no, new_no, removed_line, added_line, similarity of pairs (pair_id, old_text, new_text); null texts are empty."""
    form = lambda c: F.transform(c, normal_form)
    x = pairs.select("pair_id", *(lines_of(F.coalesce(c, F.lit(""))).alias(n) for c, n in (("old_text", "a"), ("new_text", "b"))))
    x = x.select("pair_id", "a", "b", form("a").alias("fa"), form("b").alias("fb"))
    kind = pairs.schema["pair_id"].dataType
    signature = form_signature.func

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs = {}
            for c in ("fa", "fb"):
                lists = batch.column(batch.schema.get_field_index(c))
                flat = lists.flatten()
                off = lists.offsets.to_numpy() - lists.offsets[0].as_py()
                sigs[c] = signature(flat).to_numpy(zero_copy_only=False) if len(flat) else np.zeros(0, np.int64), off
            place, held = [], []

            def out(place=place, held=held, batch=batch) -> pa.RecordBatch:
                columns = [pa.array(v, f.type) for v, f in zip(zip(*held, strict=True), ROWS, strict=True)]
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(place, pa.int32())), *columns], names=["pair_id", *ROWS.names])

            for k in range(batch.num_rows):
                a, b, fa, fb = (batch.column(n)[k].as_py() for n in range(1, 5))
                sa, sb = (sigs[c][0][sigs[c][1][k] : sigs[c][1][k + 1]] for c in ("fa", "fb"))
                rows = compare_lines(a, b, fa, fb, sa, sb, options)
                held += rows
                place += [k] * len(rows)
                if len(held) >= HELD:
                    yield out()
                    held.clear()
                    place.clear()
            if held:
                yield out()

    ddl = f"pair_id {kind.simpleString()}, seq int, classification string, old_no int, new_no int, removed_line string, added_line string, similarity double"
    return x.mapInArrow(run, ddl)
