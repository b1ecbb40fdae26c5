"""Batched generation with an injected model, and scoring of what it answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselens.functions.parsers import PARSERS, boxed_letter
from caselens.functions.text import strip


def generate(prompts: DataFrame, load: Callable[[], Callable[[list[str], list[list[str]]], list[str]]], prompt_col: str = "prompt", images_col: str = "prompt_images", batch: int = 64) -> DataFrame:
    """Add raw_output. ``load`` runs once a task and returns the model: prompts and image lists in, texts out.

    Columns pass through; outputs are stripped, a missing one is empty.
    """
    schema = prompts.withColumn("raw_output", F.lit("")).schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for f in frames:
            if model is None:
                model = load()
            out: list[str] = []
            for low in range(0, len(f), batch):
                part = f.iloc[low : low + batch]
                out += [(x or "").strip() for x in model(part[prompt_col].tolist(), [list(p) if p is not None else [] for p in part[images_col]])]
            yield f.assign(raw_output=out)

    return prompts.mapInPandas(run, schema)


def score_outputs(df: DataFrame, primary: str = "boxed") -> DataFrame:
    """Add the four predictions, whether each equals ``gold``, and the primary one as predicted and correct.

    A null prediction is right only where gold is null too.
    """
    out = df.withColumn("__text", strip(F.coalesce(F.col("raw_output"), F.lit(""))))
    out = out.withColumns({f"predicted_{p}": parse(F.col("__text")) for p, parse in PARSERS.items() if p != "boxed"})
    out = out.withColumn("predicted_boxed", F.coalesce(boxed_letter(F.col("__text")), F.col("predicted_official"))).drop("__text")  # the fallback is there already
    out = out.withColumns({f"correct_{p}": F.col(f"predicted_{p}").eqNullSafe(F.col("gold")) for p in PARSERS})
    return out.withColumns({"predicted": F.col(f"predicted_{primary}"), "correct": F.col(f"correct_{primary}"), "primary_parser": F.lit(primary)})
