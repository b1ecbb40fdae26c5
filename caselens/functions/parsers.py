"""Parsers that find the answer letter A-J in a model's output, as Column expressions.

All give NULL for a null or empty output and where nothing is found.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, strip

#: The trigger, the phrases whose letters are no answers, and the patterns, in order of precedence.
TRIGGER = "ANSWER:"
NO_ANSWERS = ["I understand", "A through J", "A through E", "A through D"]
BOXED = r"\\boxed\{\s*([A-J])\s*\}"
STRICT = [
    r"(?iU)\bANSWER\s*(?:is|:|=)\s*[\(\[\{]?\s*([A-J])\b",
    r"(?iU)(?:the\s+)?(?:correct|best|right|final)\s+answer\s*(?:is|:|=)?\s*[\(\[\{]?\s*([A-J])\b",
    r"(?iU)(?:therefore|hence|thus|so)\s*,?\s*the\s+answer\s+is\s*[\(\[\{]?\s*([A-J])\b",
    r"(?iU)[\(\[\{]\s*([A-J])\s*[\)\]\}]\s+is\s+(?:the\s+)?(?:correct|best|right)\b",
    r"(?iU)\b([A-J])\s+is\s+(?:the\s+)?(?:correct|best|right)\s+answer\b",
    r"(?U)\b([A-J])\.\s+[^:\n]{2,120}:\s*CORRECT\b",
]
LONE_LETTER = r"(?U)^\(?\s*([A-J])\s*[\)\.,;:]?\s*$"
LENIENT_PREFIX = r"(?U)^\s*(?:A|Answer|ANSWER)\s*[:\-]\s*"
LENIENT = [
    r"(?iU)(?:answer|correct answer|best answer|option|choice)\s*(?:is|:|=)?\s*(?:[\(\[\{])?\s*([A-J])\b",
    r"(?U)[\(\[\{]\s*([A-J])\s*[\)\]\}]",
    r"(?imdU)^\s*(?:Answer|A)\s*[:\-]\s*([A-J])\b",
    r"(?U)\b([A-J])\s*[)\.]",
    r"(?U)\b([A-J])\b",
]
LINE_BREAK = r"\r\n|[\n\x0B\f\r\x1C-\x1E\x85\u2028\u2029]"


def _first(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def _official(text: Column) -> Column:
    rest = F.element_at(F.split(text, TRIGGER), -1)
    for phrase in NO_ANSWERS:
        rest = F.replace(rest, F.lit(phrase), F.lit(""))
    letters = F.filter(F.split(rest, r"[^\p{L}\p{N}_]+"), lambda w: w.rlike("^[A-J]$"))
    return let(letters, lambda x: F.when(F.size(x) > 0, F.when(text.contains(TRIGGER), F.element_at(x, 1)).otherwise(F.element_at(x, -1))))


def parse_official(text: Column) -> Column:
    """The first lone letter after the last trigger, else the last lone letter of all."""
    return let(text, _official)


def boxed_letter(text: Column) -> Column:
    """The first boxed letter, null if there is none."""
    return _first(text, BOXED)


def parse_boxed(text: Column) -> Column:
    """The first boxed letter, else what ``parse_official`` finds."""
    return let(text, lambda x: F.coalesce(_first(x, BOXED), _official(x)))


def parse_strict(text: Column) -> Column:
    """Only an explicit commitment: a phrase that says so, or a letter alone on the last or the first line."""

    def find(raw: Column) -> Column:
        lines = F.filter(F.transform(F.split(raw, LINE_BREAK), strip), lambda x: x != "")
        alone = let(lines, lambda x: F.coalesce(_first(F.get(x, F.size(x) - 1), LONE_LETTER), _first(F.get(x, F.lit(0)), LONE_LETTER)))
        return F.coalesce(*[F.upper(_first(raw, p)) for p in STRICT], alone)

    return let(strip(text), find)


def parse_lenient(text: Column) -> Column:
    """The first hit of ever weaker patterns, after one leading ``Answer:`` is taken off."""
    return let(F.regexp_replace(text, LENIENT_PREFIX, ""), lambda rest: F.coalesce(*[F.upper(_first(rest, p)) for p in LENIENT]))


PARSERS = {"official": parse_official, "strict": parse_strict, "lenient": parse_lenient, "boxed": parse_boxed}
