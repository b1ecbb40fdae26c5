"""A positional inverted index over a corpus: term to the places where it stands (for problem 6).

The index knows nothing of what will be searched. It is split by document, as search engines do: each segment holds some
thousand documents and has a row for every term in them, with the term's places in order. So a term of every document
has one list a segment and none that grows with the corpus, and lists that are met with each other lie together.
A search reads only the lists of its own terms.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A segment ends with the document that reaches one of these.
SEGMENT_DOCS, SEGMENT_CHARS = 4_000, 8_000_000
#: Words that a worker remembers; at the bound the memory starts anew with the next segment.
CACHE_WORDS = 300_000
#: The terms under which a segment's documents and all tokens with a digit are listed; no token is like them.
DOCUMENTS, NUMBERS = "", "#"
#: Letters that look like Latin ones. Fixed values.
_ALIKE = str.maketrans("абвгеёзіїјкмнорѕтухԁһӏԛԝαβγεικνορτυχω", "abbreeziijkmhopstyxdhlqwabyeiknoptuxw")
_UNSEEN = frozenset("\u200b\u200c\u200d\u2060\ufeff\u00ad\u200e\u200f")
_PART = re.compile(r"[^\W_]+")
_BREAK = re.compile(r"(\w)[-‐­][ \t]*\r?\n[ \t>|*#]*(?=\w)")
_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,200}>|&(?:nbsp|ensp|emsp|thinsp|#160|#xa0);", re.I)
_QUOTE = re.compile(r"(?m)^[ \t]*(?:[>|*#]+[ \t]?)+")


def word_tokens(word: str) -> tuple[str, ...]:
    """The parts of a word as compared: runs of letters and digits, without case, marks, widths and look-alikes."""
    word = word.lower()
    if not word.isascii():
        word = "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c) and c not in _UNSEEN)
        if any("\u0370" <= c <= "\u052f" for c in word) and sum("a" <= c <= "z" for c in word):
            word = word.translate(_ALIKE)
    return tuple(_PART.findall(word))


def corpus_words(text: str) -> list[str]:
    """The words between white space, with broken words joined and mark-up taken out."""
    if "\n" in text:
        if "-\n" in text or "-\r" in text or "‐" in text or "­" in text or "- \n" in text:
            text = _BREAK.sub(r"\1", text)
        if "\n>" in text or text.startswith(">"):
            text = _QUOTE.sub("", text)
    if "<" in text or "&" in text:
        text = _TAG.sub(" ", text)
    return text.split()


class Vocabulary(dict):
    """A word as it stands in a text to the numbers of its tokens, which are given as they come."""

    def __init__(self) -> None:
        super().__init__()
        self.number: dict[str, int] = {}
        self.terms: list[str] = []
        self.digits: list[bool] = []

    def __missing__(self, word: str) -> tuple[int, ...]:
        out = []
        for t in word_tokens(word):
            n = self.number.get(t)
            if n is None:
                n = self.number[t] = len(self.terms)
                self.terms.append(t)
                self.digits.append(any(c.isdigit() for c in t))
            out.append(n)
        self[word] = known = tuple(out)
        return known

    def trimmed(self) -> Vocabulary:
        return self if len(self) < CACHE_WORDS else Vocabulary()


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers as bytes, seven bits each and the high bit set where more follow; and the bytes that each takes."""
    values = values.astype(np.uint64)
    size = np.ones(len(values), np.int64)
    for k in range(1, 5):
        size += values >= 1 << (7 * k)
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(5):
        has = size > k
        part = (values[has] >> np.uint64(7 * k)) & np.uint64(127)
        out[(ends - size)[has] + k] = part.astype(np.uint8) | np.where(size[has] > k + 1, 128, 0).astype(np.uint8)
    return out, size


def unpacked(data: np.ndarray) -> np.ndarray:
    """What ``packed`` was given."""
    if not len(data):
        return np.zeros(0, np.int64)
    first = np.concatenate([[0], np.flatnonzero(data < 128)[:-1] + 1])
    nth = np.arange(len(data)) - np.repeat(first, np.diff(np.append(first, len(data))))
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * nth), first)


def _segment(words: Vocabulary, docs: pa.Array, texts: list[str]) -> pa.RecordBatch:
    """The rows of a segment: its documents with their first places, then term, length and places of every list.

    Documents lie end to end, so that a place is one number. Words without a letter or digit take no place.
    """
    get, parts = words.__getitem__, []
    for text in texts:
        parts.append(np.fromiter(chain.from_iterable(map(get, corpus_words(text))), np.int32))
    starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    number = np.concatenate(parts)
    numeric = np.flatnonzero(np.array(words.digits, bool)[number])
    place = np.argsort(number, kind="stable")
    number, place = np.concatenate([number[place], np.full(len(numeric), len(words.terms), np.int32)]), np.concatenate([place, numeric])
    terms, first, size = np.unique(number, return_index=True, return_counts=True)
    step = np.diff(place, prepend=0)
    step[first] = place[first]
    data, width = packed(step)
    ends = np.concatenate([[0], np.cumsum(np.add.reduceat(width, first))]).astype(np.int32) if len(first) else np.zeros(1, np.int32)
    head, at = packed(np.diff(starts))
    names = [*words.terms, NUMBERS]
    term = pa.array([DOCUMENTS, *[names[t] for t in terms.tolist()]], pa.string())
    count = pa.array(np.concatenate([[len(texts)], size]).astype(np.int32))
    places = pa.BinaryArray.from_buffers(pa.binary(), len(terms) + 1, [None, pa.py_buffer(np.concatenate([[0], ends + len(head)]).astype(np.int32)), pa.py_buffer(np.concatenate([head, data]))])
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.full(len(terms) + 1, len(docs))]).astype(np.int32)), docs)
    return pa.RecordBatch.from_arrays([term, count, places, lists], names=["term", "n", "places", "docs"])


def build_index(corpus: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """term, n, places, docs: the lists of each segment, one segment after another; nothing is shuffled.

    Null texts are not in it; empty ones are documents without a place. A segment's first row has the empty term, its
    documents' ids in ``docs`` and their lengths in ``places``; elsewhere ``docs`` is empty. Rows must stay in their
    order, so the index is kept by a checkpoint, which keeps partitions as they are.
    """
    source = corpus.select(F.col(id_col).alias("d"), F.col(text_col).cast("string").alias("t")).where("t is not null")
    kind = source.schema["d"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, docs, texts, chars = Vocabulary(), [], [], 0
        for b in batches:
            sizes = np.cumsum(pc.utf8_length(b.column(1)).to_numpy())
            low = 0
            while low < b.num_rows:
                done = int(sizes[low - 1]) if low else 0
                high = int(np.searchsorted(sizes, done + SEGMENT_CHARS - chars)) + 1
                high = min(high, b.num_rows, low + SEGMENT_DOCS - len(texts))
                docs.append(b.column(0).slice(low, high - low))
                texts += b.column(1).slice(low, high - low).to_pylist()
                chars += int(sizes[high - 1]) - done
                low = high
                if len(texts) >= SEGMENT_DOCS or chars >= SEGMENT_CHARS:
                    yield _segment(words, pa.concat_arrays(docs), texts)
                    words, docs, texts, chars = words.trimmed(), [], [], 0
        if texts:
            yield _segment(words, pa.concat_arrays(docs), texts)

    return source.mapInArrow(run, f"term string, n int, places binary, docs array<{kind}>")


@dataclass
class Segment:
    """A segment's documents, and the lists of the searched terms by their numbers, ``NUMBERS`` last."""

    docs: pa.Array
    starts: np.ndarray  # first place of each document, and the end
    size: np.ndarray  # by term: places of its list
    first: np.ndarray  # by term: where its list starts in ``place``
    place: np.ndarray

    def __post_init__(self) -> None:
        words = slice(0, self.first[-1])  # the last list is that of the numbers, whose places are others' too
        self.numbers = self.place[self.first[-1] :]
        self.at = np.full(int(self.starts[-1]), -1, np.int32)  # the searched term at each place, by which lists meet at once
        self.at[self.place[words]] = np.repeat(np.arange(len(self.size)), self.size)[words]


def _put_together(head: pa.RecordBatch, rows: list[pa.RecordBatch], number: dict[str, int]) -> Segment:
    """A segment of its first row and the rows of its lists."""
    lengths = unpacked(_bytes(head.column(2)))
    term = np.array([number[x] for r in rows for x in r.column(0).to_pylist()], np.int64)
    n = np.array([x for r in rows for x in r.column(1).to_pylist()], np.int64)
    step = unpacked(np.concatenate([_bytes(r.column(2)) for r in rows])) if rows else np.zeros(0, np.int64)
    begin, total = np.cumsum(n) - n, np.cumsum(step)
    total -= np.repeat(total[begin] - step[begin], n)  # sums start anew with each list
    size = np.zeros(len(number), np.int64)
    size[term] = n
    order = np.argsort(term, kind="stable")
    place = total[np.repeat(begin[order] - np.cumsum(n[order]) + n[order], n[order]) + np.arange(int(n.sum()))]
    return Segment(head.column(3).flatten(), np.concatenate([[0], np.cumsum(lengths)]), size, np.cumsum(size) - size, place)


def segments(batches: Iterator[pa.RecordBatch], number: dict[str, int]) -> Iterator[Segment]:
    """The segments of index rows as they stand, with the lists of the terms in ``number``."""
    head: pa.RecordBatch | None = None
    rows: list[pa.RecordBatch] = []
    for b in batches:
        heads = np.flatnonzero(pc.equal(b.column(0), DOCUMENTS).to_numpy(zero_copy_only=False)).tolist()
        for low, high in zip([0, *heads], [*heads, b.num_rows]):
            if low in heads and not (low == high):
                if head is not None:
                    yield _put_together(head, rows, number)
                head, rows = b.slice(low, 1), []
                low += 1
            if low < high:
                rows.append(b.slice(low, high - low))
    if head is not None:
        yield _put_together(head, rows, number)


def _bytes(column: pa.Array) -> np.ndarray:
    """The bytes of a binary column, of a slice too."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if column.buffers()[2] is not None else np.zeros(0, np.uint8)
