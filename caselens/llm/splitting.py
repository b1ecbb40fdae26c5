"""Cutting oversized texts into pieces within a limit, at natural boundaries, with a fixed overlap (problem 2).

Balanced targets: the least piece count that can hold the text gives equal-length targets; each target is
snapped to the strongest boundary near it; when a cut would have to fall inside a word although a boundary is
in reach, the text is given one more piece and laid out anew, until every limit holds.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Boundaries from the strongest to the weakest; a cut falls at the end of a match.
BOUNDARIES = [
    re.compile(r"(?:\r\n|\r|\n)[ \t]*(?:\r\n|\r|\n)\s*"),  # a blank line
    re.compile(r"[ \t]*(?:\r\n|\r|\n)+[ \t]*"),  # a line's end
    re.compile(r"[.!?\u2026\u3002]+[\"')\]\u201d\u2019]*[ \t]+(?=[^a-z])"),  # a sentence's end
    re.compile(r"[;:,\u3001\uff0c][ \t]+"),  # a clause's end
    re.compile(r"[ \t-\r\u1680\u2000-\u200a\u2028\u2029\u205f\u3000]+"),  # a word's end
]
_RUN = re.compile(r"[^ \t\n\r]+")
#: How far from its target a cut may go for a stronger boundary, as a share of the piece's length.
NEARBY = 0.25


def longest_run(text: str) -> int:
    """Code points of the longest stretch without space, tab, line feed or carriage return."""
    return max((m.end() - m.start() for m in _RUN.finditer(text)), default=0)


def _whole(text: str, at: int, low: int) -> int:
    """The nearest place at or before ``at`` that parts neither a CR LF nor a letter and its marks, ``at`` if there is none from ``low`` on."""
    for i in range(at, low - 1, -1):
        c = text[i : i + 1]
        if not c or not (unicodedata.combining(c) or c in "\u200d\ufe0f" or (c == "\n" and text[i - 1] == "\r") or text[i - 1] == "\u200d"):
            return i
    return at


class _Places:
    def __init__(self, text: str):
        self.text = text
        self.by_strength: list[list[int]] = [[m.end() for m in p.finditer(text)] for p in BOUNDARIES]

    def nearest(self, level: int, target: float, low: int, high: int) -> int | None:
        """The boundary of a level nearest to ``target`` within [low, high]."""
        ends = self.by_strength[level]
        a, b = bisect_left(ends, low), bisect_right(ends, high)
        if a >= b:
            return None
        i = bisect_left(ends, target, a, b)
        return min((ends[j] for j in (i - 1, i) if a <= j < b), key=lambda x: abs(x - target))

    def snap(self, target: float, low: int, high: int, near: float) -> int | None:
        """The strongest boundary near the target, else the strongest within [low, high]."""
        for a, b in ((max(low, int(target - near)), min(high, int(target + near))), (low, high)):
            for level in range(len(BOUNDARIES)):
                if (at := self.nearest(level, target, a, b)) is not None:
                    return at
        return None


def least_pieces(text_size: int, ends: list[int], stride: int, overlap: int) -> int:
    """The least number of pieces that cut inside an unbroken run only where no boundary is in reach: each piece as long as
    it may be, up to its last boundary."""
    pieces, at = 1, overlap
    while text_size - at > stride:
        i = bisect_right(ends, at + stride) - 1
        at = ends[i] if i >= 0 and ends[i] > at else at + stride
        pieces += 1
    return pieces


def cut_points(text: str, max_chars: int, overlap: int) -> list[int]:
    """Where the pieces of a text end; piece i reaches from ``overlap`` before the end of piece i-1 to its own end.

    The number of pieces is the least at which every limit holds (``least_pieces``), which is the least for the text's length, and
    one more as often as a limit fails. Each target is snapped within the places from which the pieces left can still
    reach the end, so a layout of that many is always found.
    """
    n, stride = len(text), max_chars - overlap
    if n <= max_chars:
        return [n]
    places = _Places(text)
    ends = sorted({x for level in places.by_strength for x in level if overlap < x < n})
    pieces = least_pieces(n, ends, stride, overlap)
    earliest = [n]  # the end of each piece, from the last backwards, from which those after it just reach the end
    for _ in range(pieces - 1):
        end = earliest[-1]
        i = bisect_left(ends, end)
        after, before = ends[i] if i < len(ends) else n, ends[i - 1] if i else overlap
        # either up to the next boundary, or into a run without one, which is entered from its start on
        earliest.append(min(after - stride, max(before, end - stride)))
    step, cuts, at = (n - overlap) / pieces, [], overlap
    for j in range(1, pieces):
        low, high = max(at + 1, earliest[pieces - j]), min(at + stride, n - 1)
        target = min(max(overlap + j * step, low), high)
        cut = places.snap(target, low, high, NEARBY * step)
        if cut is None:  # no boundary is in reach
            cut = _whole(text, int(target), low)
        cuts.append(cut)
        at = cut
    return [*cuts, n]


def split_text(text: str, max_chars: int, overlap: int) -> list[tuple[int, int]]:
    """The (start, end) of each piece."""
    ends = cut_points(text, max_chars, overlap)
    return [(max(0, a - overlap) if i else 0, b) for i, (a, b) in enumerate(zip([0, *ends], ends))]


def split_oversized(df: DataFrame, key_cols: list[str], text_col: str, max_chars: int, overlap_chars: int, with_text: bool = True) -> DataFrame:
    """One row per piece: the key columns, n_chars, longest_run, n_pieces, piece_no from 1, piece_start, piece_end, piece_text.

    Every text of at most ``max_chars`` code points is one piece, an empty or blank one too; null texts give
    no row. Longer ones are cut so that each piece is within the limit and shares its first
    ``overlap_chars`` code points with the end of the one before. A cut falls inside an unbroken run only where
    no boundary is in reach. Rows are handled one by one, repeated rows each; ties between boundaries go to
    the earlier one. Columns beside the named ones are not read, whatever their names. No shuffle: short
    texts stay in the JVM, long ones go through Arrow.
    """
    if not 0 <= overlap_chars < max_chars:
        raise ValueError("overlap_chars must be at least 0 and less than max_chars")
    names = [f"__k{i}" for i in range(len(key_cols))]
    source = df.select(*[df[k].alias(a) for k, a in zip(key_cols, names)], df[text_col].cast("string").alias("__text")).where(F.col("__text").isNotNull())
    keys = ", ".join(f"{a} {source.schema[a].dataType.simpleString()}" for a in names)
    out = f"{keys}, n_chars int, longest_run int, n_pieces int, piece_no int, piece_start int, piece_end int" + ", piece_text string" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            index: list[int] = []
            for i, text in enumerate(batch.column(len(names)).to_pylist()):
                spans, run_length = split_text(text, max_chars, overlap_chars), longest_run(text)
                for no, (a, b) in enumerate(spans, 1):
                    index.append(i)
                    rows.append((len(text), run_length, len(spans), no, a, b, text[a:b] if with_text else None))
            columns = list(zip(*rows)) if rows else [()] * 7
            kept = batch.select(list(range(len(names)))).take(pa.array(index, pa.int32()))
            ints = [pa.array(c, pa.int32()) for c in columns[:6]]
            yield pa.RecordBatch.from_arrays([*kept.columns, *ints, *([pa.array(columns[6], pa.string())] * with_text)], names=[f.split()[0] for f in out.split(", ")])

    size = F.length("__text")
    whole = source.where(size <= max_chars).select(
        *names,
        size.alias("n_chars"),
        F.array_max(F.transform(F.split("__text", "[ \\t\\n\\r]"), F.length)).alias("longest_run"),
        F.lit(1).alias("n_pieces"),
        F.lit(1).alias("piece_no"),
        F.lit(0).alias("piece_start"),
        size.alias("piece_end"),
        *([F.col("__text").alias("piece_text")] * with_text),
    )
    cut = source.where(size > max_chars).mapInArrow(run, out)
    return whole.unionByName(cut).select(*[F.col(a).alias(k) for k, a in zip(key_cols, names)], *[c for c in cut.columns if c not in names])


def oversized_items(pieces: DataFrame, key_cols: list[str], max_chars: int) -> DataFrame:
    """Key columns and kind: a row ``oversized`` for each item in more than one piece, a further row ``unbroken``
    where a run without white space is itself beyond the limit."""
    found = pieces.where((F.col("piece_no") == 1) & (F.col("n_pieces") > 1)).select(*key_cols, F.when(F.col("longest_run") > max_chars, F.array(F.lit("oversized"), F.lit("unbroken"))).otherwise(F.array(F.lit("oversized"))).alias("kinds"))
    return found.select(*key_cols, F.explode("kinds").alias("kind")).distinct()


def limits(df: DataFrame) -> dict[str, tuple[int, int]]:
    """field_name to (max_chars, overlap_chars); a table of limits has a row a field, refused beyond 1,000."""
    rows = df.limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("a table of limits has at most 1,000 rows")
    return {r["field_name"]: (r["max_chars"], r["overlap_chars"]) for r in rows}
