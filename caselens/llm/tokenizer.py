"""Byte-level BPE encoding of a text column with a public rank vocabulary (problem 5).

A text is cut into pieces by the vocabulary's pattern, and each piece's bytes are merged pair by pair, the
pair of least rank first and of equals the leftmost. The pairs of a piece lie in a segment tree over its byte
positions whose nodes hold the leftmost least rank below them, so that a merge costs three point updates of
logarithmic depth however long the piece is: an unbroken megabyte is n log n, not n squared.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: A vocabulary is broadcast; a file beyond this size is refused.
MAX_VOCABULARY_BYTES = 64 << 20
#: Pieces remembered by a worker; at the bound the memory starts anew, with no effect on results.
CACHE_PIECES = 400_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a ``.tiktoken`` file: base64 of the bytes, blank, id."""
    with open(path, "rb") as f:
        raw = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(raw) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}


#: The characters with the Unicode property White_Space. A fixed value.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A piece of the pattern never runs on over the start of white space, so a text may be cut there first and
#: the pieces of each such stretch, which recurs far more often than a text, be remembered.
_stretches = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+").findall
_WIDE_ASCII = [c + " " for c in " \t\n\x0b\x0c\r"]
_WIDE_OTHER = [c + " " for c in "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"]


def _single_blanks(text: str) -> bool:
    """Whether every blank of the text follows something else than white space, so that the text may be split
    at blanks without a pattern."""
    if text[0] == " " or text[-1] == " " or any(w in text for w in _WIDE_ASCII):
        return False
    return text.isascii() or not any(w in text for w in _WIDE_OTHER)


#: The vocabulary's split pattern; the property names leave \x1c-\x1f out of white space, as the vocabulary does.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


@lru_cache(maxsize=1)
def _splitter():
    import regex

    return regex.compile(_PATTERN).findall


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece by the segment tree. Every single byte must be in ``ranks``."""
    n = len(piece)
    if n < 2:
        return [ranks[piece]] if n else []
    get = ranks.get
    width = 1 << (n - 1).bit_length()
    none = 1 << 62
    # a leaf's value orders by rank, then position; `none` stands for no pair that merges
    tree = [none] * (2 * width)
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            tree[width + i] = r * width + i
    for i in range(width - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    after = list(range(1, n + 1))  # where the live token that starts at i ends: the next one's start
    before = list(range(-1, n))

    def put(i: int, value: int) -> None:
        i += width
        tree[i] = value
        while i > 1:
            i >>= 1
            a, b = tree[2 * i], tree[2 * i + 1]
            least = a if a < b else b
            if tree[i] == least:
                break
            tree[i] = least

    while (top := tree[1]) != none:
        i = top & (width - 1)
        dead = after[i]
        end = after[dead]
        after[i] = end
        before[end] = i
        put(dead, none)
        r = get(piece[i : after[end]]) if end < n else None
        put(i, none if r is None else r * width + i)
        if (p := before[i]) >= 0:
            r = get(piece[p:end])
            put(p, none if r is None else r * width + p)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class _AfterBlank(dict):
    """What stands between two single blanks, to the ids of it and the blank before it."""

    def __init__(self, stretches: _Stretches):
        super().__init__()
        self.stretches = stretches

    def __missing__(self, rest: str) -> bytes:
        packed = b"".join(map(self.stretches.__getitem__, _stretches(" " + rest)))
        if len(rest) <= 64:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[rest] = packed
        return packed


class _Stretches(dict):
    """White space and what follows it, to the ids as packed int32; fills itself."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks, self.pieces, self.split, self.after_blank = ranks, {}, _splitter(), _AfterBlank(self)

    def __missing__(self, stretch: str) -> bytes:
        packed = b"".join(map(self.piece, self.split(stretch)))
        if len(stretch) <= 64:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[stretch] = packed
        return packed

    def piece(self, piece: str) -> bytes:
        packed = self.pieces.get(piece)
        if packed is None:
            raw = piece.encode("utf-8", "surrogatepass")
            known = self.ranks.get(raw)
            packed = np.array([known] if known is not None else merge_piece(raw, self.ranks), dtype=np.int32).tobytes()
            if len(piece) <= 64:
                if len(self.pieces) >= CACHE_PIECES:
                    self.pieces.clear()
                self.pieces[piece] = packed
        return packed


_worker: dict[str, _Stretches] = {}


def encode_texts(texts: list[str | None], stretches: _Stretches) -> pa.ListArray:
    known, blank, sizes, packed = stretches.__getitem__, stretches.after_blank.__getitem__, [0], []
    for text in texts:
        if not text:
            ids = b""
        elif _single_blanks(text):
            first, *rest = text.split(" ")
            ids = b"".join([*map(known, _stretches(first)), *map(blank, rest)])
        else:
            ids = b"".join(map(known, _stretches(text)))
        packed.append(ids)
        sizes.append(len(ids) // 4)
    values = np.frombuffer(b"".join(packed), dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(values))


def encode_documents(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """``id_col`` and ``out_col`` array<int>: the ids of every row's text by the vocabulary file of that path, without special tokens.

    Null and empty texts give an empty array; a blank text is white space and has ids. What looks like a
    special token is ordinary text. Repeated rows are encoded each; other columns are not read. The only data
    sent to the executors is the vocabulary, refused beyond ``MAX_VOCABULARY_BYTES``. No shuffle.
    """
    path = vocabulary
    ranks = df.sparkSession.sparkContext.broadcast(load_ranks(path))
    source = df.select(df[id_col], df[text_col].cast("string").alias("__text"))
    kind = source.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _worker:
            _worker.clear()
            _worker[path] = _Stretches(ranks.value)
        for batch in batches:
            ids = encode_texts(batch.column(1).to_pylist(), _worker[path])
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[id_col, out_col])

    return source.mapInArrow(run, f"`{id_col}` {kind}, `{out_col}` array<int>")
