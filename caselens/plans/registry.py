"""Every query of the core by name, with the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from caselens.operators.packed_values import split_packed
from caselens.session import table

from . import corpus, results, retrieval

Query = Callable[[SparkSession, str], DataFrame]


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_packed(table(spark, sf_dir, "medpix_cases"), "u_id", "differential_diagnosis")


def _all() -> dict[str, tuple[Query, str | None]]:
    return {"p3_found": (p3_found, None), **results.QUERIES, **corpus.QUERIES, **retrieval.QUERIES}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every condition against the baseline: paired tests over the last record of each question."""
    return results.QUERIES["mcnemar_pairwise"][0](spark, sf_dir)


def queries() -> dict[str, Query]:
    return {name: q for name, (q, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
