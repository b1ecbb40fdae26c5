"""Fields that hold several values, to one value a row with its position (problem 3).

A field is read into a lattice: quoted spans and JSON strings are atoms, list marks, line ends, semicolons and the
like are firm borders, and commas, slashes and connecting words are places where a value may end. Which of them do
is learned from the whole column by expectation maximisation: the frequencies of values, the lengths of values
and how often each kind of place lies inside a value. The likeliest path (Viterbi) gives the values. Stretches of any
number of atoms may be a value, up to the length of the longest value that stands whole somewhere in the column.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselens.operators.skew import hot_keys, join_unique
from caselens.session import checkpointed

#: Entries that say there is no value. Fixed values.
FILLERS = {
    "n/a", "na", "n.a.", "none", "nil", "null", "unknown", "not applicable", "not available", "not assigned", "none given", "none listed",
    "not given", "not known", "not specified", "unspecified", "pending", "tbd", "see above", "see text", "-", "--", "---", "–", "—", "?", "??", "???",
    ".", "..", "...", "…", "*", "x", "xx", "xxx",
}
_LABEL = re.compile(r"\s*[^\W\d_][^\W_]*(?:[ /-][^\W_]+){0,4}\s*:\s+(?=\S)")
_NUMBER = re.compile(r"(?:(?<=\s)|^)\(?(\d{1,3})[.)](?!\d)\s*")
_BULLET = re.compile(r"(?:^|(?<=[\r\n]))[ \t]*[-*•·‣▪●–—][ \t]*|(?<=\s)[•‣▪●][ \t]*")
_FIRM = r"[;|\t\r\n\u2028\u2029]|<br\s*/?>|(?<=\s)(?:vs\.?|versus)(?=\s)"
_BORDER = re.compile(_FIRM, re.I)
_PLACE = re.compile(rf"(?P<firm>{_FIRM})|(?P<comma>,\s*(?:(?:and/or|and|or)(?=\s))?)|(?P<slash>\s+/+\s+|/+)|(?P<word>(?<=\s)(?:and/or|and|or)(?=\s))", re.I)
_WORD = re.compile(r"[^\s,;/|-]+")
_QUOTES = {'"': '"', "“": "”", "„": "“", "«": "»"}
_EDGE = " \t\r\n\x0b\f\xa0\u2002\u2003\u2009\u200b\u3000\ufeff;,|/"
_CONNECT = re.compile(r"^(?:(?:and/or|and|or|vs\.?|versus)\s+)+|(?:\s+(?:and/or|and|or|vs\.?|versus))+$", re.I)
#: A field whose likeliest reading has this chance is settled; rounds go on with the others until no chance of theirs changes by
#: more than CLOSE, or for so many rounds.
SETTLED, CLOSE, ROUNDS = 0.999, 0.01, 30
#: Weight of the base distribution over values not seen before, and its chance of a word.
NEW_VALUE, NEW_WORD = 0.3, 1e-4
KINDS = {"comma": "c", "slash": "s", "word": "w"}


def _clean(raw: str) -> str:
    """A value without white space, separators, connecting words and enclosing quotes; '' for a filler."""
    value = raw.strip(_EDGE)
    while (less := _CONNECT.sub("", value).strip(_EDGE)) != value:
        value = less
    if len(value) > 1 and _QUOTES.get(value[0]) == value[-1] and _quoted_end(value, 0) == len(value):
        value = _unquote(value).strip()
    return "" if value.lower() in FILLERS or not value.strip(_EDGE + "\"'") else value


def _quoted_end(text: str, start: int) -> int:
    """Where the quoted span that opens at ``start`` ends, -1 if it never closes; a doubled quote is part of it."""
    close, i = _QUOTES[text[start]], start + 1
    while (i := text.find(close, i)) >= 0:
        if text[i - 1] == "\\":
            i += 1
        elif text[i + 1 : i + 2] == close:
            i += 2
        else:
            rest = text[i + 1 : i + 16].lstrip(" ")
            if not rest or rest[0] in ",;|/\t\r\n(" or re.match(r"(?:and|or|and/or|vs\.?|versus)\s|<br", rest, re.I):
                return i + 1
            i += 1
    return -1


def _unquote(span: str) -> str:
    close = span[-1]
    return span[1:-1].replace(close * 2, close).replace("\\" + close, close)


def _entries(text: str) -> list[tuple[str, bool]]:
    """The entries of a marked list, else the whole text; the flag tells whether commas belong to the values."""
    marks = [(m.start(), m.end()) for m in _BULLET.finditer(text)]
    if not marks or text[: marks[0][0]].strip():
        marks, due = [], 1
        for m in _NUMBER.finditer(text):
            if int(m[1]) == due:
                marks.append((m.start(), m.end()))
                due += 1
        if not marks or text[: marks[0][0]].strip(_EDGE):
            return [(text, False)]
    ends = [*[a for a, _ in marks[1:]], len(text)]
    return [(text[b:e], True) for (_, b), e in zip(marks, ends)]


def lattice(text: str | None) -> list[tuple[list[str], list[str], list[str]]]:
    """The firm groups of a field, each as (atoms, places between them, kinds of the places).

    A group of one atom is a value as it stands.
    """
    text = (text or "").replace("\u200b", "").replace("\ufeff", "")
    if text.strip().lower() in FILLERS or not text.strip():
        return []
    bare = text.strip()
    if bare[0] == "[" and bare[-1] == "]":
        try:
            values = json.loads(bare)
            if isinstance(values, list):
                return [([v.strip()], [], []) for v in map(str, (x for x in values if x is not None)) if v.strip() and v.strip().lower() not in FILLERS]
        except ValueError:
            text = bare[1:-1]
    if m := _LABEL.match(text):
        text = text[m.end() :]
    groups: list[tuple[list[str], list[str], list[str]]] = []
    for entry, marked in _entries(text):
        atoms, places, kinds, start, i = [], [], [], 0, 0

        def close(end: int) -> None:
            atoms.append(entry[start:end])
            groups.append((list(atoms), list(places), list(kinds)))
            atoms.clear(), places.clear(), kinds.clear()

        while i < len(entry):
            if entry[i] in _QUOTES and not entry[start:i].strip():
                end = _quoted_end(entry, i)
                if end > 0:
                    i = end
                    continue
            m = _PLACE.match(entry, i)
            if not m:
                i += 1
                continue
            kind = m.lastgroup
            if kind == "firm":
                close(m.start())
                start = i = m.end()
            elif kind == "comma" and marked:
                i = m.start() + 1
            else:
                atoms.append(entry[start : m.start()])
                places.append(m[0])
                kinds.append(kind)
                start = i = m.end()
        close(len(entry))
    return [g for g in map(_tidy, groups) if g[0]]


def _tidy(group: tuple[list[str], list[str], list[str]]) -> tuple[list[str], list[str], list[str]]:
    """The group without empty atoms and fillers."""
    atoms, places, kinds = group
    keep = [i for i, a in enumerate(atoms) if _clean(a)]
    return [atoms[i] for i in keep], [places[i - 1] for i in keep[1:]], [kinds[i - 1] for i in keep[1:]]


def is_open(groups: list) -> bool:
    return any(len(g[0]) > 1 for g in groups)


def segments(group: tuple[list[str], list[str], list[str]], longest: int) -> list[tuple[int, int, str]]:
    """(first atom, end, value) of every stretch of a group that may be a value: each atom, and all joined ones of at most
    ``longest`` words. Quoted atoms are never joined."""
    atoms, places, _ = group
    firm = [a.strip()[:1] in _QUOTES for a in atoms]
    out = []
    for i in range(len(atoms)):
        raw = atoms[i]
        out.append((i, i + 1, _clean(raw)))
        for j in range(i + 1, len(atoms)):
            raw += places[j - 1] + atoms[j]
            if firm[i] or firm[j] or _words(raw) > longest:
                break
            out.append((i, j + 1, _clean(raw)))
    return out


class Model:
    """What EM has learned beside the counts: total weight, lengths of values in words, chance of an inner place by kind."""

    def __init__(self, total: float, lengths: dict[int, float], inner: dict[str, float]):
        self.total, self.inner = max(total, 1.0), inner
        n = sum(lengths.values()) + 20.0
        self.lengths = {k: (lengths.get(k, 0.0) + 1.0) / n for k in range(1, 21)}

    def score(self, words: int, count: float, inside: str) -> float:
        """Log chance of a value of so many words across the places ``inside``; ``count`` leaves out what the field itself contributed."""
        words = min(20, max(1, words))
        p = (1 - NEW_VALUE) * max(0.0, count) / self.total + NEW_VALUE * self.lengths[words] * NEW_WORD**words
        return math.log(p) + sum(math.log(self.inner[k]) for k in inside)


def posteriors(scored: list[tuple[int, int, float]], size: int) -> list[float]:
    """The chance of each stretch (first atom, end, log chance) to be a value, by the forward and backward sums over the lattice."""
    low = float("-inf")

    def add(x: float, y: float) -> float:
        m = max(x, y)
        return m if m == low else m + math.log(math.exp(x - m) + math.exp(y - m))

    fore, back = [0.0] + [low] * size, [low] * size + [0.0]
    for a, b, s in scored:
        fore[b] = add(fore[b], fore[a] + s)
    for a, b, s in reversed(scored):
        back[a] = add(back[a], back[b] + s)
    return [math.exp(fore[a] + s + back[b] - fore[size]) for a, b, s in scored]


def best_path(scored: list[tuple[int, int, float]], size: int) -> list[tuple[int, int]]:
    """Viterbi; of equally likely paths the one with more values."""
    best: list[tuple[float, int, int] | None] = [(0.0, 0, 0)] + [None] * size
    for a, b, s in scored:
        if best[a] is not None:
            now = (best[a][0] + s, best[a][1] + 1, a)
            if best[b] is None or now[:2] > best[b][:2]:
                best[b] = now
    path, at = [], size
    while at:
        path.append((best[at][2], at))
        at = best[at][2]
    return path[::-1]


def _words(value: str) -> int:
    return len(_WORD.findall(value))


def _value_key(value: str) -> str:
    return " ".join(value.lower().split())


def _groups(segs: list, model: Model) -> Iterator[tuple[list, list[tuple[int, int, float]]]]:
    """The rows of each open group of a field with the log chance of each; rows are sorted by group, first atom and end."""
    for _, rows in groupby(segs, key=lambda x: x["g"]):
        rows = list(rows)
        scored = []
        for x in rows:
            s = model.score(x["words"], x["c"] - x["e"], x["inside"])
            if x["before"]:
                s += math.log(1 - model.inner[x["before"]])
            scored.append((x["a"], x["b"], s))
        yield rows, scored


def split_packed(df: DataFrame, key_col: str, text_col: str, value_col: str = "dx_value", model_out: dict | None = None) -> DataFrame:
    """``key_col``, pos from 1, ``value_col``: the values packed in a field, as typed.

    One field counts a key: repeated rows once, of different ones the greatest. Null, blank and filler fields give
    no row; empty parts and fillers no row and no position. A null key is a key. A value twice in a field gives
    two rows. Other columns are not read. Learning covers the whole column: every distinct field once, with the number of keys that
    hold it as its weight; groups of one certain reading are counted, not learned from. Each round re-estimates the fields that are
    not settled, until none of their chances changes; the last pass reads all fields by what was learned. Value counts are
    joined by a hash of the value, with hot values apart, so no value gathers in one task. ``model_out`` is given what was learned,
    the rounds and whether they came to an end.
    """
    cells = df.select(df[key_col].alias("k"), df[text_col].cast("string").alias("t")).where("t is not null").groupBy("k").agg(F.max("t").alias("t"))
    cells = checkpointed(cells.withColumn("sid", F.md5("t")))
    fields = cells.groupBy("sid").agg(F.first("t").alias("t"), F.count("*").alias("w"))

    def certain_values(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # values that stand whole, a row each; and a row with the text of every field that is open somewhere
        for f in frames:
            rows = []
            for sid, text, w in zip(f["sid"], f["t"], f["w"]):
                groups = lattice(text)
                rows += [(None, None, _value_key(v := _clean(g[0][0])), w, _words(v)) for g in groups if len(g[0]) == 1]
                if is_open(groups):
                    rows.append((sid, text, None, w, max(_words(_clean(x)) for g in groups for x in g[0])))
            yield pd.DataFrame(rows, columns=["sid", "t", "v", "w", "words"])

    parsed = checkpointed(fields.mapInPandas(certain_values, "sid string, t string, v string, w long, words int").withColumn("v", F.xxhash64("v")))
    certain, open_fields = parsed.where("sid is null"), parsed.where("sid is not null")
    sizes = parsed.groupBy(F.col("sid").isNull().alias("known"), F.least("words", F.lit(20)).alias("words")).agg(F.sum("w").alias("n"), F.max("words").alias("longest")).collect()
    fixed_lengths = {r["words"]: float(r["n"]) for r in sizes if r["known"]}
    longest = max((r["longest"] for r in sizes), default=0)

    def first_guess(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # every reading of a lattice alike at first: a stretch of one atom is likelier than a joined one
        for f in frames:
            rows = []
            for sid, text, w in zip(f["sid"], f["t"], f["w"]):
                for n, g in enumerate(x for x in lattice(text) if len(x[0]) > 1):
                    codes = "".join(KINDS[k] for k in g[2])
                    for a, b, v in segments(g, longest):
                        rows.append((sid, n, a, b, _value_key(v), (1.0 if b == a + 1 else 0.1) * w, _words(v), w, codes[a : b - 1], codes[a - 1 : a] if a else "", False, 1.0))
            yield pd.DataFrame(rows, columns=["sid", "g", "a", "b", "v", "e", "words", "w", "inside", "before", "done", "moved"])

    shape = "sid string, g int, a int, b int, v {}, e double, words int, w long, inside string, before string, done boolean, moved double"
    guess = open_fields.mapInPandas(first_guess, shape.format("string")).withColumn("v", F.xxhash64("v"))
    active, settled = checkpointed(guess), []
    hot = hot_keys(active.groupBy("v").agg(F.count("*").alias("n")), "v")
    # of the values that stand whole only those that an open stretch may be are counted, once
    fixed = checkpointed(certain.groupBy("v").agg(F.sum("w").cast("double").alias("c")).join(active.select("v").distinct(), "v", "left_semi"))
    inner = dict.fromkeys(KINDS.values(), 0.05)

    def everything() -> DataFrame:
        return reduce(DataFrame.unionByName, [*settled, active])

    def learned() -> tuple[Model, float]:
        """The model of the present chances, and how far those not settled moved."""
        rows = everything()
        words = [F.sum(F.when(F.least("words", F.lit(20)) == n, F.col("e"))).alias(f"n_{n}") for n in range(1, 21)]
        ended = [F.sum(F.when(F.col("before") == k, F.col("e"))).alias(f"at_{k}") for k in inner]
        within = [F.sum(F.col("e") * (F.length("inside") - F.length(F.replace("inside", F.lit(k), F.lit(""))))).alias(f"in_{k}") for k in inner]
        got = rows.agg(*words, *ended, *within, F.max(F.when(~F.col("done"), F.col("moved"))).alias("moved")).first()
        if rounds:
            for k in inner:
                inside, ends = got[f"in_{k}"] or 0.0, got[f"at_{k}"] or 0.0
                inner[k] = min(0.5, max(1e-4, (inside + 0.5) / (inside + ends + 10.0)))
        lengths = {n: fixed_lengths.get(n, 0.0) + (got[f"n_{n}"] or 0.0) for n in range(1, 21)}
        return Model(sum(lengths.values()), lengths, dict(inner)), got["moved"] or 0.0

    def by_field(rows: DataFrame) -> DataFrame:
        """The rows of each field with the present counts of their values."""
        counts = everything().select("v", F.col("e").alias("c")).unionByName(fixed).groupBy("v").agg(F.sum("c").alias("c"))
        met = join_unique(rows, counts, "v", hot=hot)
        return met.groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("g", "a", "b", "v", "e", "c", "words", "w", "inside", "before"))).alias("s"))

    rounds = 0
    now, change = learned()
    while rounds < ROUNDS and change > CLOSE:

        def expect(frames: Iterator[pd.DataFrame], now=now) -> Iterator[pd.DataFrame]:
            for f in frames:
                rows = []
                for sid, s in zip(f["sid"], f["s"]):
                    sure, moved, new = 1.0, 0.0, []
                    for group, scored in _groups(s, now):
                        size = max(b for _, b, _ in scored)
                        chances = posteriors(scored, size)
                        of = {(a, b): p for (a, b, _), p in zip(scored, chances)}
                        sure *= min(of[x] for x in best_path(scored, size))
                        for x, p in zip(group, chances):
                            moved = max(moved, abs(p - x["e"] / x["w"]))
                            new.append((sid, x["g"], x["a"], x["b"], x["v"], p * x["w"], x["words"], x["w"], x["inside"], x["before"]))
                    rows += [(*x, sure >= SETTLED, moved) for x in new]
                yield pd.DataFrame(rows, columns=["sid", "g", "a", "b", "v", "e", "words", "w", "inside", "before", "done", "moved"])

        new = checkpointed(by_field(active).mapInPandas(expect, shape.format("long")))
        settled.append(new.where("done"))
        active, rounds = new.where("not done"), rounds + 1
        now, change = learned()
    if model_out is not None:
        model_out.update(total=now.total, lengths=now.lengths, inner=now.inner, longest=longest, rounds=rounds, converged=change <= CLOSE)

    def likeliest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"sid": f["sid"], "cuts": ["|".join(",".join(str(b) for _, b in best_path(x, max(b for _, b, _ in x))) for _, x in _groups(s, now)) for s in f["s"]]})

    path = by_field(everything()).mapInPandas(likeliest, "sid string, cuts string")

    def values(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for k, text, cuts in zip(f["k"], f["t"], f["cuts"]):
                ways, pos = iter(cuts.split("|") if isinstance(cuts, str) else ()), 0
                for atoms, places, _ in lattice(text):
                    if len(atoms) == 1:
                        found = [atoms[0]]
                    else:
                        a, found = 0, []
                        for b in map(int, next(ways).split(",")):
                            found.append("".join(x + y for x, y in zip(atoms[a:b], [*places[a : b - 1], ""])))
                            a = b
                    for raw in found:
                        if value := _clean(raw):
                            pos += 1
                            rows.append((k, pos, value))
            yield pd.DataFrame(rows, columns=["k", "pos", "v"])

    kind = cells.schema["k"].dataType.simpleString()
    out = join_unique(cells, path, "sid").select("k", "t", "cuts").mapInPandas(values, f"k {kind}, pos int, v string")
    return out.select(F.col("k").alias(key_col), "pos", F.col("v").alias(value_col))
