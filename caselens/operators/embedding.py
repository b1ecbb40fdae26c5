"""Embedding of texts by an injected model, dense or sparse."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .retrieval import concept_words


def embed(df: DataFrame, text_col: str, load: Callable[[], Callable[[list[str]], list]], out: str = "vector", batch: int = 64) -> DataFrame:
    """Add ``out`` array<double>. ``load`` runs once a task and returns the model: a batch of texts in, a vector each out.

    A null text and a vector with NaN or infinity give null. Columns pass through. No shuffle.
    """
    schema = StructType([*df.drop(out).schema.fields, StructField(out, ArrayType(DoubleType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for f in frames:
            if model is None:
                model = load()
            texts, vectors = f[text_col].tolist(), []
            for low in range(0, len(texts), batch):
                part = [t for t in texts[low : low + batch] if t is not None]
                vectors += [v if np.isfinite(v).all() else None for v in (np.asarray(x, float) for x in (model(part) if part else []))]
            got = iter(vectors)
            yield f.assign(**{out: pd.Series([None if t is None else next(got) for t in texts], index=f.index, dtype=object)})[schema.names]

    return df.mapInPandas(run, schema)


def sparse_embed(df: DataFrame, id_col: str, text_col: str, load: Callable[[], Callable[[list[str]], list[dict[str, float]]]] | None = None, batch: int = 64) -> DataFrame:
    """``id_col``, term, weight: the terms of each text with their weights, by an injected model; without one the words and how
    often each occurs."""
    if load is None:
        words = df.select(id_col, F.explode(concept_words(F.col(text_col))).alias("term"))
        return words.groupBy(id_col, "term").agg(F.count("*").cast("double").alias("weight"))
    kind = df.schema[id_col].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for f in frames:
            if model is None:
                model = load()
            rows = []
            f = f[f["t"].notna()]
            for low in range(0, len(f), batch):
                part = f.iloc[low : low + batch]
                rows += [(i, term, float(w)) for i, weights in zip(part["i"], model(part["t"].tolist())) for term, w in weights.items()]
            yield pd.DataFrame(rows, columns=["i", "term", "weight"])

    found = df.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInPandas(run, f"i {kind}, term string, weight double")
    return found.withColumnRenamed("i", id_col)


def hashed_words(dims: int = 64) -> Callable[[], Callable[[list[str]], list]]:
    """A model that needs no weights, to stand in for one: each word between blanks counts in a place and with a sign that its hash picks."""

    def load():
        @functools.lru_cache(100_000)
        def place(w: str) -> int:
            h = int(hashlib.md5(w.encode()).hexdigest()[:7], 16)
            return h % dims + (0 if h // dims % 2 else dims)

        def model(texts: list[str]) -> list:
            out = np.zeros((len(texts), dims))
            for i, text in enumerate(texts):
                n = np.bincount([place(w) for w in text.split(" ") if w] or [0, dims], minlength=2 * dims)
                out[i] = n[:dims] - n[dims:]
            return list(out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12))

        return model

    return load
