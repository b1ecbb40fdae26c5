"""String functions of the matching audit, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no concept. Fixed values.
STOP_WORDS = ["the", "a", "of", "and", "or", "in", "on", "to", "with", "by", "for"]
#: White space of any script, as a regular-expression class body.
SPACE = r"\s\x0B\x1C-\x1F\x85\p{Z}"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def normalise(text: Column) -> Column:
    """Lower case, punctuation to blanks, single blanks; null becomes ''."""
    words = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), rf"[^\p{{L}}\p{{N}}_{SPACE}]", " ")
    return F.trim(F.regexp_replace(words, f"[{SPACE}]+", " "))


def is_substring(needle: Column, hay: Column) -> Column:
    """Whether the normalised needle lies in the normalised hay; false if either is empty."""
    return let(F.struct(normalise(needle).alias("n"), normalise(hay).alias("h")), lambda x: (x["n"] != "") & (x["h"] != "") & x["h"].contains(x["n"]))


def concept_tokens(text: Column) -> Column:
    """Distinct normalised words of at least three letters that are no stop words."""
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.array_distinct(F.filter(F.split(normalise(text), " "), lambda w: (F.length(w) >= 3) & ~F.array_contains(stop, w)))


def token_set_ratio(a: Column, b: Column) -> Column:
    """Shared words of two token arrays in percent of the smaller one, cut to an integer; 0 if ``a`` is empty."""

    def ratio(x: Column) -> Column:
        shared, least = F.size(F.array_intersect(x["a"], x["b"])), F.greatest(F.least(F.size(x["a"]), F.size(x["b"])), F.lit(1))
        return F.when(F.size(x["a"]) == 0, 0).otherwise(F.floor(100 * shared / least)).cast("int")

    return let(F.struct(a.alias("a"), b.alias("b")), ratio)


def is_fuzzy_match(needle: Column, hay: Column, threshold: int = 90) -> Column:
    """Whether two texts have words and share at least ``threshold`` percent of them."""
    a, b = concept_tokens(needle), concept_tokens(hay)
    return (normalise(needle) != "") & (normalise(hay) != "") & (token_set_ratio(a, b) >= threshold)
