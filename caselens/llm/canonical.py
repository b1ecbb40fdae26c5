"""Mapping freely typed values to the entries of a reference list (problem 4).

Distinct values are normalised to words. An inverted index of character n-grams over the list's words gives the words that
a typed one may stand for, each with its agreement from 0 to 1; an inverted index of the list's words gives the candidate
entries of a value, scored by the weighted cosine of words in which words that agree count as one by their agreement.
A candidate is accepted where the part of its own weight that the value holds is above the threshold, and the best by cosine
where it leads by the margin over others that are accepted and do not lie inside it.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselens.operators.skew import join_unique
from caselens.session import checkpointed

#: The list is broadcast; a longer one is refused.
MAX_LIST_ROWS = 200_000
#: Least part of an entry's weight that a value must hold, less MISSING a word of the entry that it lacks; and the lead that the
#: best cosine must have over that of another accepted entry.
THRESHOLD, MISSING, MARGIN = 0.87, 0.1, 0.02
#: Length of n-grams, and least weighted cosine of n-grams of two words that are compared letter by letter.
GRAM, ALIKE, SHORT = 2, 0.2, 6
#: Agreement of a word with its plural, with what it is cut short from, and what each edit takes off.
PLURAL, CUT, EDIT = 0.99, 0.92, 0.04
#: Words whose meaning a worker remembers; at the bound the memory starts anew.
CACHE_WORDS = 300_000
_FOLD = str.maketrans({"œ": "oe", "æ": "ae", "ø": "o", "ß": "ss", "ł": "l", "đ": "d", "ı": "i"})
#: Spellings that differ between the two sides of the Atlantic or by ear. Fixed values, applied in order.
_SPELL = [("oe", "e"), ("ae", "e"), ("our", "or"), ("y", "i"), ("z", "s"), ("k", "c")]
_ROMAN = {"i": "1", "ii": "2", "iii": "3", "iv": "4", "v": "5", "vi": "6", "vii": "7", "viii": "8", "ix": "9", "x": "10"}
_TOKEN = re.compile(r"(?:[^\W\d_]\.){2,}[^\W\d_]?(?![^\W_])|[^\W\d_]+(?:['’][^\W\d_]+)?|\d+")


@lru_cache(maxsize=200_000)
def word_key(word: str) -> str:
    """A word as compared: without marks and case, spelling variants as one, letters not doubled."""
    w = "".join(c for c in unicodedata.normalize("NFKD", word.lower().translate(_FOLD)) if not unicodedata.combining(c))
    for a, b in _SPELL:
        w = w.replace(a, b)
    return re.sub(r"(\D)\1+", r"\1", w)


_TYPE = word_key("type")


def tokens(text: str) -> list[tuple[str, str, bool]]:
    """(as typed, key, cut short) of each word; dotted initials are one word, and so is ``type`` with its number."""
    text = unicodedata.normalize("NFKC", text).replace("_", " ").replace("\u00ad", "").replace("\u200b", "")
    out: list[tuple[str, str, bool]] = []
    for m in _TOKEN.finditer(text):
        raw = m[0].replace(".", "")
        key = word_key(raw)
        if out and out[-1][1] == _TYPE and (key.isdigit() or raw.lower() in _ROMAN):
            out[-1] = (raw, _TYPE + _ROMAN.get(raw.lower(), key), False)  # a numbered type is one word, never nearly another
            continue
        out.append((raw, key, text[m.end() : m.end() + 1] == "…" or text[m.end() : m.end() + 3] == "..."))
    return out


def within(a: str, b: str, most: int) -> int:
    """Edits (insert, delete, replace, swap of neighbours) between two words, ``most`` + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            now[j] = min(row[j] + 1, now[j - 1] + 1, row[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                now[j] = min(now[j], before[j - 2] + 1)
        if min(now) > most:
            return most + 1
        before, row = row, now
    return row[-1]


def _forms(key: str) -> set[str]:
    """The word and its plurals."""
    out = {key, key + "s", key + "es", key + "e", key + "tes", key + "ta"}
    if key.endswith("is"):
        out.add(key[:-2] + "es")
    if key.endswith("i"):  # anomaly, anomalies
        out |= {key + "es", key + "e"}
    if key.endswith("um"):
        out.add(key[:-2] + "a")
    return {re.sub(r"(\D)\1+", r"\1", w) for w in out}


class Grams:
    """Words by their character n-grams: an inverted index whose lists are added up from the rarest n-gram on."""

    def __init__(self, words: list[str]):
        self.words = words
        post: dict[str, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            for g in self.of(w):
                post[g].append(i)
        n = max(1, len(words))
        self.weight = {g: float(np.log(1 + n / len(p))) ** 2 for g, p in post.items()}
        self.post = dict(post)
        self.norm = [sum(self.weight[g] for g in self.of(w)) ** 0.5 for w in words]

    @staticmethod
    def of(word: str) -> set[str]:
        """The n-grams of a word; of a short one its letters too, as neighbours that changed places leave few n-grams."""
        padded = f"#{word}#"
        return {padded[i : i + GRAM] for i in range(len(padded) - GRAM + 1)} | (set(word) if len(word) <= SHORT else set())

    def near(self, word: str) -> list[str]:
        """The words whose weighted cosine with ``word`` is at least ``ALIKE``.

        A word first met when the n-grams left weigh too little to bring it there is not taken up: sums over a word's own
        n-grams can't exceed what is left, so nothing is lost.
        """
        grams = sorted((g for g in self.of(word) if g in self.post), key=lambda g: len(self.post[g]))
        left = size = sum(self.weight[g] for g in grams) or 1.0
        least = min(self.norm, default=1.0) * size**0.5 * ALIKE
        score: dict[int, float] = {}
        for g in grams:
            w = self.weight[g]
            if left >= least:
                for i in self.post[g]:
                    score[i] = score.get(i, 0.0) + w
            else:
                for i in self.post[g]:
                    if i in score:
                        score[i] += w
            left -= w
        return [self.words[i] for i, x in score.items() if x >= ALIKE * self.norm[i] * size**0.5]


class Index:
    """The words of a reference list by n-grams, and its entries by words."""

    def __init__(self, rows: list[tuple[int, str | None, str | None]]):
        self.ids: list[int] = []
        self.words: list[list[str]] = []
        self.joined: dict[str, list[str]] = {}  # hyphened words written as one
        self.short: dict[str, list[int]] = defaultdict(list)
        for ref_id, name, short in rows:
            for text, is_short in ((name, False), (short, True)):
                words = [k for _, k, _ in tokens(text or "")]
                if ref_id is not None and words:
                    if is_short:
                        self.short[short.replace(".", "").strip().lower()].append(len(self.ids))
                    self.ids.append(ref_id)
                    self.words.append([] if is_short else words)
                    for pair in re.findall(r"([^\W\d_]+)-([^\W\d_]+)", text):
                        self.joined["".join(map(word_key, pair))] = [word_key(w) for w in pair]
        self.post: dict[str, list[tuple[int, int]]] = defaultdict(list)  # word to entries, and its place in them
        for i, ws in enumerate(self.words):
            for k, w in enumerate(ws):
                self.post[w].append((i, k))
        self.plain: dict[str, list[str]] = defaultdict(list)
        for w in self.post:
            for form in _forms(w):
                self.plain[form].append(w)
        # a word weighs between 1 and 2, more the fewer entries have it
        n = max(2, len(self.ids))
        self.weight = {w: 1 + float(np.log(n / len(p)) / np.log(n)) for w, p in self.post.items()}
        self.size = [sum(self.weight[w] for w in ws) for ws in self.words]
        self.grams = Grams(sorted(self.post))
        self._known: dict[tuple[str, bool], list[tuple[str, float]]] = {}

    def stands_for(self, key: str, cut: bool, typed_length: int) -> list[tuple[str, float]]:
        """The list's words that a typed word may stand for, with their agreement."""
        hit = self._known.get((key, cut))
        if hit is None:
            if len(self._known) > CACHE_WORDS:
                self._known.clear()
            hit = self._known[key, cut] = self._stands_for(key, cut, typed_length)
        return hit

    def _stands_for(self, key: str, cut: bool, typed_length: int) -> list[tuple[str, float]]:
        if key in self.post:
            return [(key, 1.0)]
        if key in self.plain:
            return [(w, PLURAL) for w in self.plain[key]]
        if key[-1:].isdigit():
            return []
        near = self.grams.near(key)
        begins = [w for w in near if len(key) >= (2 if cut else 3) and w.startswith(key)]
        if cut and begins:
            return [(w, CUT) for w in begins]
        size = max(len(key), typed_length)
        most = 0 if size < 3 else 1 if size < 6 else 2 if size < 10 else 3
        best: list[str] = []
        least = most + 1
        for w in near:
            d = min(within(f, key, least) for f in (w, w + "s", w + "es"))
            if d < least:
                best, least = [w], d
            elif d == least and d <= most:
                best.append(w)
        if best and (least == 1 or not begins):
            return [(w, 1 - EDIT * least) for w in best]
        if begins:
            return [(w, CUT) for w in begins] + [(w, 1 - EDIT * least) for w in best if w not in begins]
        if len(key) >= 5:  # a typing error in a word cut short
            return [(w, CUT - EDIT) for w in near if len(w) > len(key) and w[0] == key[0] and within(w[: len(key)], key, 1) <= 1]
        return []

    def lookup(self, value: str) -> tuple[int, float]:
        """(ref_id, score) of the entry a value names; ref_id 0 for none, with the score of the best candidate."""
        typed = [x for raw, key, cut in tokens(value) for x in ([(k, k, False) for k in self.joined[key]] if key in self.joined else [(raw, key, cut)])]
        met: dict[int, list[tuple[float, int, int]]] = defaultdict(list)
        held: dict[int, float] = {}
        for at, (raw, key, cut) in enumerate(typed):
            for word, agree in self.stands_for(key, cut or at == len(typed) - 1, len(raw)):
                for entry, place in self.post[word]:
                    met[entry].append((-agree, at, place))
            for entry in self.short.get(raw.lower(), ()):
                held[entry] = 1.0
        scored = [(1.0, 1.0, e) for e in held]  # (cosine, part held, entry); the value's own length is the same for all
        for entry, pairs in met.items():
            words, used, placed, total = self.words[entry], set(), set(), 0.0
            for agree, at, place in sorted(pairs):  # a typed word counts for one word of the entry
                if at not in used and place not in placed:
                    used.add(at)
                    placed.add(place)
                    total -= agree * self.weight[words[place]]
            part = total / self.size[entry] - MISSING * (len(words) - len(placed))
            scored.append((total / self.size[entry] ** 0.5, part, entry))
        accepted = sorted((-cosine, e, part) for cosine, part, e in scored if part >= THRESHOLD)
        if not accepted:
            return 0, max((part for _, part, _ in scored), default=0.0)
        cosine, top, part = accepted[0]
        own = set(self.words[top])
        for other, e, _ in accepted[1:]:
            if other - cosine >= MARGIN:
                break
            if self.ids[e] != self.ids[top] and not (self.words[e] and set(self.words[e]) <= own):
                return 0, part
        return self.ids[top], part


#: The index a worker has built, by the mark of the call it belongs to.
_worker: dict[str, Index] = {}


def map_to_list(values: DataFrame, reference: DataFrame, key_cols: list[str], value_col: str, id_col: str = "ref_id", name_col: str = "dx_name", short_col: str = "short_form") -> DataFrame:
    """The key columns, ref_id (0: names none) and score of every row whose value is not null or blank.

    Repeated rows are mapped each; distinct values are looked up once. Of two entries a value holds equally well
    it names none. An empty list maps everything to 0; entries without a name count by their short form. The list
    is broadcast, refused beyond ``MAX_LIST_ROWS``; values meet their results by a hash of the value, very common ones
    apart. Other columns are not read.
    """
    rows = [tuple(r) for r in reference.select(id_col, name_col, short_col).distinct().orderBy(id_col, name_col, short_col).limit(MAX_LIST_ROWS + 1).collect()]
    if len(rows) > MAX_LIST_ROWS:
        raise ValueError(f"a reference list has at most {MAX_LIST_ROWS} rows")
    sent, mark = values.sparkSession.sparkContext.broadcast(rows), uuid.uuid4().hex
    at = values.select(*key_cols, F.col(value_col).cast("string").alias("__v")).where(F.length(F.regexp_replace("__v", r"[\s\u00a0\u2000-\u200b\u202f\u3000\ufeff]", "")) > 0)
    at = at.withColumn("__h", F.md5("__v"))
    each = at.groupBy("__h").agg(F.first("__v").alias("__v"), F.count("*").alias("__n"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if mark not in _worker:
            _worker.clear()
            _worker[mark] = Index(sent.value)
        find = _worker[mark].lookup
        for f in frames:
            got = [find(v) for v in f["__v"]]
            yield pd.DataFrame({"__h": f["__h"], "__n": f["__n"], "ref_id": [g[0] for g in got], "score": [round(g[1], 6) for g in got]})

    # written once: the join reads it for the common values and again for the rest
    found = checkpointed(each.mapInPandas(run, "__h string, __n long, ref_id long, score double"))
    return join_unique(at.drop("__v"), found.drop("__n"), "__h", counts=found.select("__h", F.col("__n").alias("n"))).drop("__h")
