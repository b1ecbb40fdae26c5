"""Held-out items that leak into a corpus, by a positional inverted index over the corpus (problem 6).

The index (``postings.py``) holds the places of every term of the corpus. In each of its segments an item's lists are
met from the rarest on, at equal offsets (place in the document less place in the item); what the rarest phrases
bring up is looked for in the item's other lists, and pairs that share enough are checked over all their words: exact
phrases, and runs that follow the item nearly word by word, judged by how they differ from it, so that another question
of the same make does not count.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselens.session import checkpointed, local_frame

from .postings import DOCUMENTS, NUMBERS, Segment, build_index, corpus_words, segments, word_tokens

#: The items are broadcast; a larger set is refused. Several sets can be searched one after another over one index.
MAX_ITEMS, MAX_ITEM_WORDS = 20_000, 2_000_000
#: Words of one stretch that an item and a document must share; of several stretches (sentences in another order) in all,
#: and in each.
LEAST_WORDS, LEAST_IN_ALL, LEAST_OF_SEVERAL = 18, 22, 8
#: Matches that must agree with each other, and of these the ones at the very same offset.
LEAST_RUN, LEAST_EVEN = 5, 3
#: A run must follow the item in FOLLOWED of its words, each of several runs in FOLLOWED_OF_SEVERAL. It is judged by how it agrees and differs:
#: words that sister questions lack speak for a leak by the log of their chance there; what fits the words around it in the
#: items, or a number for a number, is how a sister question differs (ALIKE), any other word is how an altered copy does
#: (OTHER). Chances keep off 0 and 1 by SURE; LEAST_ODDS is a leak. SPARSE: see ``_dense_part``.
FOLLOWED, FOLLOWED_OF_SEVERAL, ALIKE, OTHER, SURE, LEAST_ODDS, SLOT, SPARSE = 0.77, 0.95, -6.0, 1.5, 0.03, 5.0, 6, 0.8
#: Offsets of one run differ by at most so many words from match to match; a run's matches lie that near each other.
DRIFT, GAP = 3, 6
#: Phrases of a stretch whose lists are met first; phrases that must meet at one offset; tokens in ``LEAST_WORDS`` in a row that
#: must then be found there, and their share of what these tokens weigh that sister questions lack.
RAREST, LEAST_MET, LEAST_NEAR, LEAST_OWN = 12, 4, 12, 0.6


class Items:
    """The held-out items: tokens with their words, the phrases of two that they hold, and how likely a sister question has a token too."""

    def __init__(self, rows: list[tuple[int, str]]):
        split = [(i, _sentences(t)) for i, t in rows]
        unlike = {tuple(x for s in ss for w in s for x in w): ss for _, ss in split}
        closing = Counter(tuple(x for w in ss[-1] for x in w) for ss in unlike.values() if len(ss) > 1)
        self.ids, self.tokens, self.word_of, known = [], [], [], {}
        for i, sentences in split:
            if len(sentences) > 1 and closing[tuple(x for w in sentences[-1] for x in w)] > 1:
                sentences = sentences[:-1]  # a stock question
            flat = [(n, x) for n, word in enumerate(w for ss in sentences for w in ss) for x in word]
            same = tuple(x for _, x in flat)
            if same in known:
                self.ids[known[same]].append(i)  # said twice it is one item, not its own sister
            elif flat:
                known[same] = len(self.ids)
                self.ids.append([i])
                self.word_of.append(np.array([f[0] for f in flat]))
                self.tokens.append([f[1] for f in flat])
        self.vocabulary = {w: k for k, w in enumerate(dict.fromkeys(w for ws in self.tokens for w in ws))}
        self.vocabulary[NUMBERS] = len(self.vocabulary)
        self.terms = [np.array([self.vocabulary[w] for w in ws], np.int32) for ws in self.tokens]
        self.starts = np.concatenate([[0], np.cumsum([len(t) for t in self.terms])]).astype(np.int64)
        self.term = np.concatenate(self.terms).astype(np.int64) if self.terms else np.zeros(0, np.int64)
        self.item = np.repeat(np.arange(len(self.terms)), np.diff(self.starts))
        self.place = np.arange(len(self.term)) - np.repeat(self.starts[:-1], np.diff(self.starts))
        self.longest = int(np.diff(self.starts).max()) if self.terms else 0
        self.sorted = [(order := np.argsort(t, kind="stable"), t[order]) for t in self.terms]
        # by token the phrases that begin there, with no and with one word between, -1 beyond the item's end
        self.begins = np.full((len(self.term), 2), -1, np.int64)
        for apart in (1, 2):
            k = np.flatnonzero(self.item[apart:] == self.item[:-apart])
            self.begins[k, apart - 1] = (self.term[k] * len(self.vocabulary) + self.term[k + apart]) * 2 + apart - 1
        self.phrase = np.unique(self.begins[self.begins >= 0])
        self.begins = np.where(self.begins >= 0, np.searchsorted(self.phrase, self.begins), -1)
        self.slot = self._slots()
        chance = np.concatenate(self.slot) if self.slot else np.zeros(0)
        self.own = np.where(chance < 0.5, -np.log(np.maximum(chance, SURE)), 0.0)

    def _slots(self) -> list[np.ndarray]:
        """For each token of an item the chance that a sister question has it too: the share of the other items with the same
        two tokens before (after) it that have this one there, the lesser of both; by the two sides' nearest token where no
        other item has the two, and the least chance where none has that."""
        size, starts = len(self.vocabulary) + 1, np.cumsum([0] + [len(t) for t in self.terms])
        chance = np.full(starts[-1], np.nan)
        for step in (-1, 1):
            side = np.full(starts[-1], np.nan)
            for width in (2, 1):
                around = []
                for t in self.terms:
                    code = np.zeros(len(t), np.int64)
                    for k in range(1, width + 1):
                        other = np.zeros(len(t), np.int64)  # 0 stands beyond the ends
                        if len(t) > k:
                            (other[k:] if step < 0 else other[:-k])[:] = (t[:-k] if step < 0 else t[k:]) + 1
                        code = code * size + other
                    around.append(code)
                frame = np.unique(np.concatenate(around), return_inverse=True)[1] if around else np.zeros(0, np.int64)
                term = np.concatenate(self.terms).astype(np.int64) if self.terms else np.zeros(0, np.int64)
                item = np.repeat(np.arange(len(self.terms)), np.diff(starts))
                alike = frame * size + term
                n, same = (_others(x, item, len(self.terms)) for x in (frame, alike))
                use = np.isnan(side) & (n > 0)
                side[use] = same[use] / n[use]
            chance = np.fmin(chance, side)
        if not self.terms:
            return []
        # a word that many items hold is no more than that a surprise
        held = _others(np.concatenate(self.terms).astype(np.int64), item, len(self.terms)) / len(self.terms)
        chance = np.maximum(np.nan_to_num(chance, nan=0.0), np.minimum(held, 0.45))
        return np.split(np.clip(chance, SURE, 1 - SURE), starts[1:-1])


def _others(key: np.ndarray, item: np.ndarray, n_items: int) -> np.ndarray:
    """How many other items have the key, for each key and item of the list."""
    pairs = np.unique(key * max(1, n_items) + item) // max(1, n_items)
    keys, count = np.unique(pairs, return_counts=True)
    return count[np.searchsorted(keys, key)] - 1 if len(key) else key


def _sentences(text: str) -> list[list[tuple[str, ...]]]:
    """Sentences as lists of words, each the tuple of its tokens."""
    out = [[t for t in map(word_tokens, corpus_words(p)) if t] for p in re.split(r"(?<=[.!?])\s+(?=\S)", text.strip())]
    return [x for x in out if x]


def runs(size: int, place: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The stretches of an item of ``size`` tokens that a document follows, each as the places matched.

    ``place`` and ``at`` are the matches: places in the item and in the document. A match counts where at least
    ``LEAST_RUN`` agree with it, itself among them: near in the item, and at an offset that drifts little; ``LEAST_EVEN`` of
    them at the very same offset, as a word that a sister question has in another slot nearby is alone with its own.
    """
    off = at - place
    order = np.argsort(off, kind="stable")
    place, off = place[order], off[order]
    # matches whose offset has too few others near it can't count; most chance matches go here
    lo, hi = np.searchsorted(off, off - DRIFT, "left"), np.searchsorted(off, off + DRIFT, "right")
    some = hi - lo >= LEAST_RUN
    place, off = place[some], off[some]
    hit = np.zeros(size, bool)
    even = np.flatnonzero(np.searchsorted(off, off, "right") - np.searchsorted(off, off, "left") >= LEAST_EVEN)
    for a in range(0, len(even), 512):  # offsets are in order: only neighbours need be compared
        some = even[a : a + 512]
        lo, hi = np.searchsorted(off, [off[some[0]] - DRIFT, off[some[-1]] + DRIFT + 1])
        p, o = place[some], off[some]
        near, apart = np.abs(p[:, None] - place[None, lo:hi]) <= 2 * GAP, np.abs(o[:, None] - off[None, lo:hi])
        hit[p[((near & (apart <= DRIFT)).sum(1) >= LEAST_RUN) & ((near & (apart == 0)).sum(1) >= LEAST_EVEN)]] = True
    where = np.flatnonzero(hit)
    return np.split(where, np.flatnonzero(np.diff(where) > GAP) + 1) if len(where) else []


def _dense_part(run: np.ndarray) -> np.ndarray:
    """The part of a run with the greatest count of matched tokens less ``SPARSE`` times the missing ones."""
    gain = np.full(int(run[-1] - run[0]) + 1, -SPARSE)
    gain[run - run[0]] = 1.0
    total = np.concatenate([[0.0], np.cumsum(gain)])
    end = int((total[1:] - np.minimum.accumulate(total[:-1])).argmax()) + 1
    start = int(total[:end].argmin())
    return run[(run >= run[0] + start) & (run < run[0] + end)]


def _difference(items: Items, item: int, k: int, z: int, place: np.ndarray, at: np.ndarray, term: np.ndarray, where: np.ndarray, number: np.ndarray) -> float:
    """What it says that a document has something else for the tokens ``k`` to ``z`` of an item: ``ALIKE`` if it has what sister
    questions have there, a number for a number or words that other items have between the same neighbours."""
    terms, size = items.terms[item], len(items.vocabulary)
    left, right = at[place == k - 1], at[place == z]
    step = right[None, :] - left[:, None]
    far = np.where(step > 0, np.abs(step - (z - k + 1)), 1 << 30)
    i, j = np.unravel_index(far.argmin(), far.shape)
    low, high = np.searchsorted(where, [left[i] + 1, right[j]])
    got, places = term[low:high], where[low:high]
    if any(c.isdigit() for w in items.tokens[item][k:z] for c in w):
        low, high = np.searchsorted(number, [left[i] + 1, right[j]])
        return ALIKE if high > low else OTHER
    if step[i, j] < 2 or not len(got):
        return OTHER
    known = lambda a, b: (n := np.searchsorted(items.phrase, x := (int(a) * size + int(b)) * 2)) < len(items.phrase) and items.phrase[n] == x
    before, after = places[0] == left[i] + 1 and known(terms[k - 1], got[0]), places[-1] == right[j] - 1 and known(got[-1], terms[z])
    return ALIKE if before or after else OTHER


def _altered_part(items: Items, item: int, run: np.ndarray, *doc: np.ndarray) -> tuple[np.ndarray, float]:
    """The part of a run that is likeliest an altered copy rather than a sister question, the longest of like ones, and its
    log odds. Up to ``SLOT`` neighbouring words that sister questions lack are one piece of evidence, and what is said again is no more."""
    a, b = int(run[0]), int(run[-1]) + 1
    chance, terms = items.slot[item], items.terms[item]
    hit = np.zeros(b - a, bool)
    hit[run - a] = True
    odds, said, k = np.zeros(b - a), set(), a
    while k < b:
        z = k + 1
        if not hit[k - a]:
            while z < b and not hit[z - a]:
                z += 1
            odds[k - a] = _difference(items, item, k, z, *doc)
        elif chance[k] < 0.5:
            while z < b and z - k < SLOT and hit[z - a] and chance[z] < 0.5:
                z += 1
            words = tuple(terms[k:z].tolist())
            if words not in said:
                said.add(words)
                odds[k - a] = -np.log(chance[k:z].min())
        k = z
    total = np.concatenate([[0.0], np.cumsum(odds)])
    gain = total[1:] - np.minimum.accumulate(total[:-1])
    end = len(gain) - int((gain[::-1] >= gain.max() - 1e-9).argmax())
    start = int((total[:end] <= total[:end].min() + 1e-9).argmax())
    return run[(run >= a + start) & (run < a + end)], float(gain.max())


def longest_phrase(words: np.ndarray, place: np.ndarray, at: np.ndarray) -> int:
    """Words of the longest stretch of an item that a document has token by token."""
    order = np.lexsort((place, at - place))
    place, offset = place[order], (at - place)[order]
    new = np.ones(len(place), bool)
    new[1:] = (np.diff(place) != 1) | (np.diff(offset) != 0)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(place)) - 1
    return int((words[place[last]] - words[place[first]]).max()) + 1 if len(first) else 0


def score(items: Items, item: int, place: np.ndarray, at: np.ndarray, term: np.ndarray, where: np.ndarray, number: np.ndarray) -> tuple[int, int, int]:
    """Words in all runs of an item that a document follows, in the longest, and in the longest exact phrase; (0, 0, 0) if that
    is no leak: neither a phrase of ``LEAST_WORDS`` nor a run of them, nor several shorter runs of ``LEAST_IN_ALL``.

    ``term`` and ``where`` are the document's item words and their places, ``number`` the places of its numbers."""
    words = items.word_of[item]
    phrase = longest_phrase(words, place, at)
    best, total, good = phrase if phrase >= LEAST_WORDS else 0, 0, 0
    for whole in runs(len(words), place, at):
        run = _dense_part(whole)
        if words[run[-1]] - words[run[0]] + 1 < LEAST_OF_SEVERAL:
            continue
        run, odds = _altered_part(items, item, run, place, at, term, where, number)
        if odds < LEAST_ODDS or not len(run):
            continue
        span, followed = int(words[run[-1]] - words[run[0]] + 1), len(np.unique(words[run]))
        if span >= LEAST_WORDS and followed >= FOLLOWED * span:
            best = max(best, span)
        if span >= LEAST_OF_SEVERAL and followed >= FOLLOWED_OF_SEVERAL * span:
            total, good = total + span, good + 1
    return (max(best, total), best, phrase) if best or (good > 1 and total >= LEAST_IN_ALL) else (0, 0, 0)


def _lists(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places of several lists one after another: from ``first``, ``n`` each."""
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


def phrases(items: Items, seg: Segment) -> tuple[np.ndarray, np.ndarray]:
    """The phrases of two item terms next to each other or with one word between, met in all documents of a segment at once:
    length of each phrase's list, and the lists, one after another."""
    code, at = [], []
    for apart in (1, 2):
        p = np.flatnonzero((seg.at[:-apart] >= 0) & (seg.at[apart:] >= 0))
        code.append((seg.at[p].astype(np.int64) * len(items.vocabulary) + seg.at[p + apart]) * 2 + apart - 1)
        at.append(p)
    code, at = np.concatenate(code), np.concatenate(at)
    if not len(items.phrase):
        return np.zeros(0, np.int64), at[:0]
    which = np.minimum(np.searchsorted(items.phrase, code), len(items.phrase) - 1)
    known = items.phrase[which] == code
    which, at = which[known], at[known]
    return np.bincount(which, minlength=len(items.phrase)), at[np.argsort(which, kind="stable")]


def rarest(items: Items, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token of all items, 0 or 1 word between) of the phrases that are met first: in each stretch of ``LEAST_WORDS`` tokens
    of an item the ``RAREST`` with the shortest lists. ``size`` has each phrase's, those in no document take no part."""
    far, width = np.int64(1) << 60, LEAST_WORDS - 1
    n = np.where(items.begins >= 0, size[items.begins], 0)
    n = np.where(n > 0, n, far)
    spread = np.full((len(n) + (len(items.ids) + 1) * (width - 1), 2), far)
    at = np.arange(len(n)) + (items.item + 1) * (width - 1)
    spread[at] = n
    windows = np.lib.stride_tricks.sliding_window_view(spread.ravel(), 2 * width)[::2]
    least = np.partition(windows, RAREST - 1, axis=1)[:, RAREST - 1]
    none = np.zeros(width - 1, np.int64)
    most = np.lib.stride_tricks.sliding_window_view(np.concatenate([none, least, none]), width).max(1)[at]
    return np.nonzero((n < far) & (n <= most[:, None]))


def candidates(items: Items, seg: Segment) -> np.ndarray:
    """(document, item) pairs that share enough of a stretch: the lists of its rarest phrases are met at equal offsets (place in
    the document less place in the item), and what ``LEAST_MET`` of them bring up is looked for in the lists of the
    item's other terms."""
    size, lists = phrases(items, seg)
    none = np.zeros((0, 2), np.int64)
    if not size.sum():
        return none
    token, between = rarest(items, size)
    phrase = items.begins[token, between]
    n = size[phrase]
    g, token = lists[_lists((np.cumsum(size) - size)[phrase], n)], np.repeat(token, n)
    doc, place = np.searchsorted(seg.starts, g, "right") - 1, items.place[token]
    span, bits = int(np.diff(seg.starts).max()) + 2 * items.longest + DRIFT + 1, items.longest.bit_length()
    pair, offset = doc * len(items.ids) + items.item[token], g - seg.starts[doc] - place + items.longest
    if (len(seg.docs) * len(items.ids) * span) << bits < 1 << 63:  # all three in one number, which sorts fastest
        key = np.sort((pair * span + offset) << bits | place)
        place = key & ((1 << bits) - 1)
        pair, offset = np.divmod(key >> bits, span)
    else:
        order = np.lexsort((place, offset, pair))
        pair, offset, place = pair[order], offset[order], place[order]
    # runs of offsets that drift little; those where enough phrases lie near each other in the item are looked at
    new = np.ones(len(pair), bool)
    new[1:] = (np.diff(offset) > DRIFT - 1) | (np.diff(pair) != 0)
    first = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    order = np.lexsort((place, run)) if len(first) << bits >= 1 << 63 else np.argsort(run << bits | place, kind="stable")
    p = place[order]
    close = np.zeros(len(first), bool)
    m = LEAST_MET - 1
    close[run[order][m:][(run[order][m:] == run[order][:-m]) & (p[m:] - p[:-m] < LEAST_WORDS)]] = True
    low, high = np.minimum.reduceat(place, first)[close], np.maximum.reduceat(place, first)[close]
    last = np.append(first[1:], len(pair))[close] - 1
    first = first[close]
    pair, early, late = pair[first], offset[first] - items.longest, offset[last] - items.longest
    got = [np.zeros(0, np.int64)]
    for a, b in _chunks(pair, 20_000):  # so many runs at a time, whatever their number; a pair's runs stay together
        got.append(_met(items, seg, pair[a:b], early[a:b], late[a:b], low[a:b], high[a:b]))
    kept = np.concatenate(got)
    return np.stack([kept // len(items.ids), kept % len(items.ids)], 1)


def _chunks(key: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Stretches of about ``size`` of a sorted array that part no equal ones."""
    a = 0
    while a < len(key):
        b = int(np.searchsorted(key, key[min(a + size, len(key)) - 1], "right"))
        yield a, b
        a = b


def _met(items: Items, seg: Segment, pair: np.ndarray, early: np.ndarray, late: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The pairs of which ``LEAST_NEAR`` tokens in ``LEAST_WORDS`` of the item are met in their runs of offsets together, and
    ``LEAST_OWN`` of what these tokens weigh that sister questions lack."""
    item, doc = pair % len(items.ids), pair // len(items.ids)
    a = items.starts[item] + np.maximum(0, low - LEAST_WORDS)
    b = np.minimum(items.starts[item + 1], items.starts[item] + high + LEAST_WORDS)
    n = b - a
    at, run = _lists(a, n), np.repeat(np.arange(len(pair)), n)
    place, term = items.place[at], items.term[at]
    start, end = seg.starts[doc][run], seg.starts[doc + 1][run]
    hit = np.zeros(len(at), bool)
    first = start + early[run] + place - 1
    width = late - early + 3
    for k in range(int(width.max())):  # the places next to where the token would stand; runs of offsets are short
        g = first + k
        some = np.flatnonzero((g >= start) & (g < end) & (k < width[run]))
        hit[some] |= seg.at[g[some]] == term[some]
    pairs, which = np.unique(pair, return_inverse=True)
    n = np.diff(items.starts)[pairs % len(items.ids)]
    ends = np.cumsum(n)
    met = np.zeros(int(ends[-1]), np.int64)
    met[(ends - n)[which[run[hit]]] + place[hit]] = 1
    own = items.own[_lists(items.starts[pairs % len(items.ids)], n)]
    last = np.minimum(np.arange(len(met)) + LEAST_WORDS, np.repeat(ends, n))
    near, mine, all_ = (x[last] - x[:-1] for x in (np.concatenate([[0], np.cumsum(y)]) for y in (met, met * own, own)))
    return pairs[np.logical_or.reduceat((near >= LEAST_NEAR) & (mine >= LEAST_OWN * all_), ends - n)]


def search(items: Items, seg: Segment) -> list[tuple[int, int, int, int, int]]:
    """(document, item, words, longest run, longest phrase) of every leak in a segment."""
    pairs = candidates(items, seg)
    if not len(pairs):
        return []
    out, last = [], -1
    for d, i in pairs.tolist():
        if d != last:  # the searched words of the document and its numbers, with their places
            a, b, last = int(seg.starts[d]), int(seg.starts[d + 1]), d
            p = np.flatnonzero(seg.at[a:b] >= 0)
            t, digits = seg.at[a:b][p], seg.numbers[slice(*np.searchsorted(seg.numbers, [a, b]))] - a
        order, words = items.sorted[i]
        lo, hi = np.searchsorted(words, t, "left"), np.searchsorted(words, t, "right")
        n = hi - lo
        place, at = order[_lists(lo, n)], np.repeat(p, n)
        total, longest, phrase = score(items, i, place, at, t, p, digits) if len(at) else (0, 0, 0)
        if total:
            out.append((d, i, total, longest, phrase))
    return out


def find_leaks(corpus: DataFrame, heldout: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "item_text", index: DataFrame | None = None) -> DataFrame:
    """item_id, ``id_col``, n_words, longest_run, longest_phrase of every item and document that carries enough of it: words in
    all its runs, in the longest, and in the longest stretch that is there word for word (an exact phrase; the rest is proximity).

    ``index`` is the corpus's, if it was built before (``postings.build_index``, checkpointed); one index serves any
    number of searches. Null and empty texts carry nothing; null, empty and blank items leak nowhere; items whose text
    is the same leak alike. A document twice in the corpus is reported twice. Closing sentences that items of different
    text share are left out of the items. Every list of every document is searched and none is cut. Looked at is a pair
    for which ``LEAST_MET`` of the ``RAREST`` shortest lists of a stretch's phrases (two terms, at most one word between) meet at
    offsets within ``DRIFT`` and that then has ``LEAST_NEAR`` of ``LEAST_WORDS`` tokens in a row. A changed word spoils four
    phrases at most, so a stretch with two words changed is always looked at; with more it depends on which. What is
    looked at is then judged by ``score``. Other columns are not read.
    """
    spark = corpus.sparkSession
    texts = heldout.select(F.col(item_id_col).cast("long"), F.col(item_text_col).cast("string")).where(F.col(item_text_col).isNotNull() & F.col(item_id_col).isNotNull()).distinct()
    rows = sorted(tuple(r) for r in texts.limit(MAX_ITEMS + 1).collect())
    if len(rows) > MAX_ITEMS or sum(len(t.split()) for _, t in rows) > MAX_ITEM_WORDS:
        raise ValueError(f"at most {MAX_ITEMS} items of {MAX_ITEM_WORDS} words in all are searched at a time")
    items = Items(rows)
    sent = spark.sparkContext.broadcast(items)
    kind = corpus.schema[id_col].dataType.simpleString()
    if index is None:
        index = checkpointed(build_index(corpus, id_col, text_col))
    # the items' terms are bounded, and only their lists leave the JVM
    terms = local_frame(spark, [(t,) for t in (DOCUMENTS, *items.vocabulary)], "term string")
    lists = index.join(F.broadcast(terms), "term", "left_semi")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        its = sent.value
        for seg in segments(batches, its.vocabulary):
            got = [(item, d, *counts) for d, i, *counts in search(its, seg) for item in its.ids[i]]
            if got:
                item, d, *counts = zip(*got)
                columns = [pa.array(item, pa.int64()), seg.docs.take(pa.array(d, pa.int32())), *(pa.array(c, pa.int32()) for c in counts)]
                yield pa.RecordBatch.from_arrays(columns, names=["item_id", "d", "n_words", "longest_run", "longest_phrase"])

    found = lists.mapInArrow(match, f"item_id long, d {kind}, n_words int, longest_run int, longest_phrase int")
    return found.withColumnRenamed("d", id_col)
