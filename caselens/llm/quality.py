"""Statistics of every text, and a classifier that tells prose from lists, tables and junk (problem 7).

The statistics are sums over words, each word's share looked up once, and over lines. Rules that only fire on
clear cases label a bounded sample; gradient-boosted trees are fitted to it, and their margin is turned into a
probability by a logistic curve fitted to hand-checked texts of ``holdout.py`` that take no part in training.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .holdout import ANCHORS, CALIBRATION, MEASURED

#: Frequent function words of English, German, French and Spanish. Fixed values.
COMMON = frozenset(
    """the of and to in a is was were be been are that this it its for with as at by on not or an from but which there when have has had no
    one after before while then than so she he they we you who his her their our if all can would could may some more
    der die das und ist mit von den dem des ein eine einer einen im zu auf für nicht es sich war wurde waren auch bei nach aus wie oft aber doch keine haben wir dieser diese unter zwischen
    le la les et du un une est dans pour par sur au aux que qui ne pas ce cette il elle se sans avec été avait plus sont peut être son sa en depuis entre deux
    el los las y del que se por con para una su al lo como más pero sus o este fue ha había también sin sobre esta cuando muy hasta desde eran hubo""".split()
)
STATS = [
    "n_chars", "n_words", "n_lines", "mean_word_len", "longest_word", "symbol_ratio", "digit_ratio", "upper_ratio", "space_ratio", "end_punct_lines", "bullet_lines", "short_line_words",
    "words_per_line", "common_share", "letter_word_share", "number_word_share", "distinct_share", "separator_share", "prose_words", "clean_word_share", "listed_share",
]
#: Rows of the labelled sample the trees are fitted to, at most; a documented bound, whatever the corpus.
SAMPLE_ROWS = 8_000
CACHE_WORDS = 300_000
_BULLET = re.compile(r"\s*(?:[-*+•·‣▪●–—#>]|\(?\d{1,3}[.)]|[a-zA-Z][.)]|[Nn]o\.? ?\d{1,3}\b)\s*\S")
_END = frozenset(".!?:;\"'”’)»…。")
_STRIP = ".,;:!?()[]\"'“”‘’«»„…¿¡*_\u200b\u200c\u200d\u2060\ufeff\u00ad"
_PLAIN = frozenset(".,;:-()'\"’\u200b\u200c\u200d\u2060\ufeff\u00ad")
_TAIL = " \t\r\n\xa0\u200b\u200c\u200d\u2060\ufeff"
_UNSEEN = re.compile("[\u00ad\u200b\u200c\u200d\u2060\ufeff]")
#: Words that number the entries of a list and are common words besides. Fixed values.
_MARKS = frozenset(["no"])
_INSIDE = re.compile(r"[^\W\d_]+(?:['’.-][^\W\d_]+)*")
_FIELD = 40
_MASK = (1 << _FIELD) - 1


class _Words(dict):
    """A word to its contributions, packed into one integer: characters, symbols, digits, capitals, common,
    of letters only, number, separator, letters in one case, before a comma or semicolon."""

    def __missing__(self, word: str) -> int:
        core = _UNSEEN.sub("", word).strip(_STRIP)
        symbols = sum(not c.isalnum() and c not in _PLAIN for c in word)
        letters = bool(core) and _INSIDE.fullmatch(core) is not None
        clean = letters and (core.islower() or core.isupper() or core[1:].islower() or "-" in core or "'" in core)
        number = bool(core) and not letters and any(c.isdigit() for c in core) and sum(c.isalpha() for c in core) <= 2
        fields = (len(word), symbols, sum(c.isdigit() for c in word), sum(c.isupper() for c in word), core.lower() in COMMON, letters, number, not core, clean, word[-1] in ",;")
        packed = 0
        for f in reversed(fields):
            packed = packed << _FIELD | int(f)
        if len(word) <= 40:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = packed
        return packed


_words = _Words()


def _unpack(packed: int) -> list[int]:
    return [packed >> (_FIELD * i) & _MASK for i in range(10)]


def text_stats(text: str | None) -> list[float]:
    """The values of ``STATS``; all 0 for a null, empty or blank text."""
    if not text or not (words := text.split()):
        return [float(len(text or "")), *[0.0] * (len(STATS) - 1)]
    get = _words.__getitem__
    lines = [x for x in text.splitlines() if x and not x.isspace()] if len(words) > 1 else [text]
    total, ended, bullets, short, prose, count = 0, 0, 0, 0, 0, len(lines)
    for line in lines:
        own = line.split()
        packed = sum(map(get, own))
        total += packed
        n = len(own)
        ended += line.rstrip(_TAIL)[-1:] in _END
        marked = _BULLET.match(line) is not None
        if marked and own[0].lower() in _MARKS:
            total -= 1 << _FIELD * 4  # the word is a mark, not one of a sentence
            packed -= 1 << _FIELD * 4
        bullets += marked
        if n < 5:
            short += n
        common, letters = packed >> (_FIELD * 4) & _MASK, packed >> (_FIELD * 5) & _MASK
        if n >= 5 + 3 * marked and common >= 0.16 * n and letters >= 0.6 * n:
            prose += n
    chars, symbols, digits, upper, common, letters, numbers, separators, clean, listed = _unpack(total)
    n = len(words)
    return [
        float(len(text)), float(n), float(count), chars / n, float(len(max(words, key=len))), symbols / chars, digits / chars, upper / chars, 1 - chars / len(text), ended / count, bullets / count, short / n,
        n / count, common / n, letters / n, numbers / n, len(set(words)) / n, separators / n, prose / n, clean / n, listed / n,
    ]


def weak_labels(x: np.ndarray) -> np.ndarray:
    """1 for clear lists, tables and junk, 0 for clear prose, -1 where the rules say nothing."""
    c = {name: x[:, i] for i, name in enumerate(STATS)}
    out = np.full(len(x), -1)
    prose = (c["common_share"] >= 0.2) & (c["letter_word_share"] >= 0.75) & (c["prose_words"] >= 0.75) & (c["listed_share"] < 0.2) & (c["symbol_ratio"] < 0.05) & (c["clean_word_share"] >= 0.7)
    junk = (
        (c["prose_words"] <= 0.25) & ((c["common_share"] < 0.1) | (c["number_word_share"] > 0.3) | (c["separator_share"] > 0.2) | (c["symbol_ratio"] > 0.2))
        | (c["symbol_ratio"] > 0.3)
        | ((c["listed_share"] > 0.25) & (c["n_words"] >= 12) & (c["common_share"] < 0.28))
        | ((c["common_share"] < 0.04) & (c["n_words"] >= 8))
        | ((c["distinct_share"] < 0.06) & (c["n_words"] >= 60))
        | ((c["letter_word_share"] < 0.55) & (c["common_share"] < 0.22))
        | ((c["clean_word_share"] < 0.5) & (c["common_share"] < 0.2))
    )
    out[prose] = 0
    out[junk & ~prose] = 1
    out[c["n_words"] == 0] = -1
    return out


@dataclass
class Trees:
    """Boosted trees of fixed depth in arrays; ``slope`` and ``shift`` turn the margin into a probability."""

    feature: np.ndarray  # tree, inner node
    cut: np.ndarray
    leaf: np.ndarray  # tree, leaf
    base: float
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        rows, out = np.arange(len(x)), np.full(len(x), self.base)
        inner = self.feature.shape[1]
        for f, t, v in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), dtype=np.int64)
            while_depth = int(np.log2(inner + 1))
            for _ in range(while_depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += v[node - inner]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.shift, -50, 50)))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, ridge: float = 1.0) -> Trees:
    """Gradient boosting of the logistic loss on binned features, second-order gains."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    code = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    inner, at = 2**depth - 1, np.full(len(y), base)
    feature, cut, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-at))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-6)
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                slot = (node - first) * (bins + 1) + code[:, j]
                gs = np.bincount(slot, g, width * (bins + 1)).reshape(width, -1).cumsum(1)
                hs = np.bincount(slot, h, width * (bins + 1)).reshape(width, -1).cumsum(1)
                gl, hl, ga, ha = gs[:, : len(e)], hs[:, : len(e)], gs[:, -1:], hs[:, -1:]
                gain = gl**2 / (hl + ridge) + (ga - gl) ** 2 / (ha - hl + ridge) - ga**2 / (ha + ridge)
                gain[(hl < 1) | (ha - hl < 1)] = 0
                k = gain.argmax(1)
                better = gain[np.arange(width), k] > best
                best[better] = gain[np.arange(width), k][better]
                feature[t, first : first + width][better] = j
                cut[t, first : first + width][better] = e[k[better]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[t, node]] > cut[t, node])
        gs, hs = np.bincount(node - inner, g, inner + 1), np.bincount(node - inner, h, inner + 1)
        leaf[t] = rate * gs / (hs + ridge)
        at += leaf[t, node - inner]
    return Trees(feature, cut, leaf, base)


def calibrate(model: Trees, texts: list[tuple[int, str]]) -> Trees:
    """Fit slope and shift of the logistic curve to hand-checked texts by Newton's method, lightly held to 1 and 0."""
    y = np.array([label for label, _ in texts], float)
    m = model.margin(np.array([text_stats(t) for _, t in texts]))
    w = np.array([1.0, 0.0])
    z = np.stack([m, np.ones_like(m)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -50, 50)))
        grad = z.T @ (y - p) - 0.05 * (w - [1.0, 0.0])
        hess = (z * (p * (1 - p))[:, None]).T @ z + 0.05 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w = w + np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    model.slope, model.shift = float(max(w[0], 0.05)), float(w[1])
    return model


def quality_stats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Trees | None = None) -> DataFrame:
    """``id_col``, the columns of ``STATS`` and, with a model, ``p_junk``.

    Null, empty and blank texts have 0 everywhere but n_chars and a null p_junk. Lines are what Python's splitlines
    parts; words are what white space parts. Repeated rows are measured each; other columns are not read. No shuffle.
    """
    source = df.select(df[id_col].alias("__id"), df[text_col].cast("string").alias("__text"))
    kind = source.schema[0].dataType.simpleString()
    out = f"__id {kind}, " + ", ".join(f"{s} double" for s in STATS) + ", p_junk double" * (model is not None)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x = np.array([text_stats(t) for t in f["__text"]], float).reshape(len(f), len(STATS))
            got = pd.DataFrame(x, columns=STATS)
            got.insert(0, "__id", f["__id"].to_numpy())
            if model is not None:
                got["p_junk"] = np.where(x[:, 1] > 0, model.probability(x), np.nan)
            yield got

    got = source.mapInPandas(run, out).withColumnRenamed("__id", id_col)
    return got.withColumn("p_junk", F.when(~F.isnan("p_junk"), F.col("p_junk"))) if model is not None else got


def train_quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS) -> Trees:
    """The trees fitted to about ``rows`` texts drawn by a hash of id and text, and to the hand-checked anchors.

    Rows the rules leave open are not fitted to. Of rows with the same id and text one is drawn, so repeated rows can't
    crowd the sample; hand-checked texts that calibrate or measure are left out of it. The anchors are in every training set,
    so both kinds are there whatever the corpus; an empty one trains on them alone.
    """
    total = df.count()
    hand = [hashlib.md5(t.encode()).hexdigest() for _, t in CALIBRATION + MEASURED]
    sample = df.select(F.xxhash64(df[id_col], df[text_col].cast("string"), F.lit(7)).alias("i"), df[text_col].cast("string").alias("t")).where(F.col("t").isNotNull() & ~F.md5("t").isin(hand))
    if total > rows:
        sample = sample.where(F.pmod("i", F.lit(1_000_003)) < int(1_000_003 * rows / total))
    got = quality_stats(sample.dropDuplicates(["i"]), "i", "t").orderBy("i").limit(2 * rows).toPandas()
    x = got[STATS].to_numpy(float).reshape(-1, len(STATS))
    y = weak_labels(x)
    anchors = np.array([text_stats(t) for _, t in ANCHORS])
    x, y = np.concatenate([x[y >= 0], anchors]), np.concatenate([y[y >= 0], [label for label, _ in ANCHORS]])
    return calibrate(fit_trees(x, y.astype(float)), CALIBRATION)


def measured(model: Trees, texts: list[tuple[int, str]] = MEASURED) -> dict[str, float]:
    """Precision and recall of junk, share of right labels and mean calibration error (Brier score) on hand-checked texts."""
    y = np.array([label for label, _ in texts])
    p = model.probability(np.array([text_stats(t) for _, t in texts]))
    hit = p >= 0.5
    both = float((hit & (y == 1)).sum())
    return {"precision": both / max(1, hit.sum()), "recall": both / max(1, (y == 1).sum()), "accuracy": float((hit == y).mean()), "brier": float(((p - y) ** 2).mean()), "texts": len(y)}
