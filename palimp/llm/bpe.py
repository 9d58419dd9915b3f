"""Byte-level BPE by per-prefix dynamic programming.

The encoding of a prefix ends in exactly one token, and it is a token that ends there and is compatible with the last token of the prefix before it. So for every prefix
of a piece the tokens that end there (matches of the vocabulary's automaton, longest first) are tested against the stored last token of what precedes, and
the one that passes is stored; back-pointers from the end give the ids, in time linear in the piece. Two tokens are compatible if BPE, applied to their bytes, gives
those two: merges of either side are undone from the latest to the first, and at no time may a merge over the border have been due.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed by the tokenizer format: how a text is cut into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Entries of each of the two generations of the pieces' memory, and of the pairs'.
MEMORY, PAIRS = 150_000, 500_000
#: Longer pieces are not remembered.
LONG = 64
FOREVER = 1 << 60


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte: itself if it is printable Latin-1, else the next free one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, free = {chr(b): b for b in shown}, 256
    for b in range(256):
        if b not in shown:
            out[chr(free)] = b
            free += 1
    return out


class _Memory(dict):
    """Encoded pieces, in two generations: what the younger one lacks comes from the older one or is computed."""

    def __init__(self, compute):
        super().__init__()
        self.compute, self.older = compute, {}

    def __missing__(self, piece: str) -> str:
        got = self.older.get(piece)
        if got is None:
            got = self.compute(piece)
        if len(piece) <= LONG:
            if len(self) >= MEMORY:
                self.older = dict(self)
                self.clear()
            self[piece] = got
        return got


class BytePairCoder:
    def __init__(self, definition: bytes | str):
        d = json.loads(definition)
        model, alphabet = d["model"], byte_alphabet()
        vocab, merges = model["vocab"], [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self.special = {t["content"]: t["id"] for t in d.get("added_tokens") or []}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.size = size
        self.bytes: list[bytes] = [b""] * size
        for t, i in vocab.items():
            self.bytes[i] = t.encode() if t in self.special else bytes(alphabet[c] for c in t)
        for t, i in self.special.items():
            self.bytes[i] = t.encode()
        self.rank, self.left, self.right = [-1] * size, [-1] * size, [-1] * size
        self.pair: dict[int, int] = {}
        for r, (a, b) in enumerate(merges):
            i, j, k = vocab[a], vocab[b], vocab[a + b]
            self.pair.setdefault(i * size + j, r)
            if self.rank[k] < 0:
                self.rank[k], self.left[k], self.right[k] = r, i, j
        self.known: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for t, i in vocab.items():
            if t not in self.special:
                self.automaton.add_word(self.bytes[i].decode("latin-1"), (i, len(self.bytes[i])))
        self.automaton.make_automaton()
        self.by_text = {str(i): b for i, b in enumerate(self.bytes)}
        self.memory = _Memory(lambda piece: ",".join(map(str, self.encode_piece(piece.encode("utf-8", "replace")))))
        self.cut = regex.compile(PIECES).findall
        self.at_special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def _due(self, a: int, b: int, limit: int) -> bool:
        """If no merge over the border of a and b comes before those that made them; limit: the time at which the pair itself is consumed."""
        rank, left, right, pair, size = self.rank, self.left, self.right, self.pair, self.size
        while True:
            r = pair.get(a * size + b)
            if r is not None and r < limit:
                return False
            ra, rb = rank[a], rank[b]
            if ra > rb:
                limit, a = ra, right[a]
            elif rb >= 0:
                limit, b = rb + 1, left[b]
            else:
                return True

    def compatible(self, a: int, b: int) -> bool:
        key = a * self.size + b
        got = self.known.get(key)
        if got is None:
            if len(self.known) >= PAIRS:
                self.known.clear()
            got = self.known[key] = self._due(a, b, FOREVER)
        return got

    def canonical(self, t: int) -> bool:
        """If BPE encodes the token's own bytes as the token."""
        got = self.whole.get(t)
        if got is None:
            if self.rank[t] < 0:
                got = len(self.bytes[t]) == 1
            else:
                a, b = self.left[t], self.right[t]
                got = self.canonical(a) and self.canonical(b) and self._due(a, b, self.rank[t])
            self.whole[t] = got
        return got

    def encode_piece(self, piece: bytes) -> list[int]:
        n = len(piece)
        last, step = [-1] * (n + 1), [0] * (n + 1)
        known, size, whole = self.known, self.size, self.whole
        for end, (t, m) in self.automaton.iter(piece.decode("latin-1")):
            end += 1
            if last[end] >= 0:
                continue
            if m == end:
                ok = whole.get(t)
                if ok is None:
                    ok = self.canonical(t)
            else:
                before = last[end - m]
                if before < 0:
                    continue
                ok = known.get(before * size + t)
                if ok is None:
                    ok = self.compatible(before, t)
                ok = ok and self.canonical(t)
            if ok:
                last[end], step[end] = t, m
        out = []
        while n > 0:
            out.append(last[n])
            n -= step[n]
        out.reverse()
        return out

    def encode_text(self, text: str) -> str:
        """Ids of a text, in decimal, joined by commas."""
        if not text:
            return ""
        memory, cut = self.memory, self.cut
        if self.at_special is None or not any(t in text for t in self.special):
            return ",".join([memory[p] for p in cut(text)])
        out = []
        for part in self.at_special.split(text):
            if part in self.special:
                out.append(str(self.special[part]))
            elif part:
                out += [memory[p] for p in cut(part)]
        return ",".join(out)

    def decode_text(self, ids: str) -> str:
        """The text of ids as encode_text gives them; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.by_text.__getitem__, ids.split(","))).decode("utf-8", "replace") if ids else ""


_coders: dict[str, BytePairCoder] = {}


def coder_of(definition: bytes) -> BytePairCoder:
    """One coder for each Python worker and definition."""
    key = hashlib.sha256(definition).hexdigest()
    if key not in _coders:
        _coders.clear()
        _coders[key] = BytePairCoder(definition)
    return _coders[key]


def _definition(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array<int>), of each row; a null or empty text has no ids. The tokenizer file (a path on the driver) goes to the executors as a broadcast of its fixed size."""
    got = docs.sparkSession.sparkContext.broadcast(_definition(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(got.value)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                ids = [[int(x) for x in s.split(",")] if s else [] for s in (coder.encode_text(t) for t in part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return base.mapInArrow(run, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text of each row of ids; null ids give null."""
    got = encoded.sparkSession.sparkContext.broadcast(_definition(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(got.value)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = [None if x is None else b"".join(coder.bytes[j] for j in x).decode("utf-8", "replace") for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    base = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    return base.mapInArrow(run, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, text string")


def encode_digest(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes and decodes each whole text in one pass, and returns digests only.

    Null texts are empty: no ids, digests of the empty string. Repeated rows give a row each; other columns are ignored. No shuffle.
    """
    got = docs.sparkSession.sparkContext.broadcast(_definition(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(got.value)
        sha = hashlib.sha256
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                n, a, b = [], [], []
                for text in part.column(1).to_pylist():
                    ids = coder.encode_text(text or "")
                    n.append(ids.count(",") + 1 if ids else 0)
                    a.append(sha(ids.encode()).hexdigest())
                    b.append(sha(coder.decode_text(ids).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return base.mapInArrow(run, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
