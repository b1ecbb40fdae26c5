"""Audit tables as text. Each is a row a condition, pair or stratum, so it fits on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import audit, coverage


def lines(title: str, df: DataFrame, order: list) -> list[str]:
    """A heading, the column names and every row, columns aligned."""
    rows = [[_cell(v) for v in r] for r in df.orderBy(*order).toLocalIterator()]
    wide = [max(map(len, column)) for column in zip(df.columns, *rows)]
    return [f"== {title}", *["  ".join(x.ljust(w) for x, w in zip(r, wide)).rstrip() for r in (df.columns, *rows)]]


def _cell(v) -> str:
    return "-" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)


def mcnemar_report(latest: DataFrame, baseline: str = audit.BASELINE) -> list[str]:
    return [
        *lines("accuracy", audit.wilson_by_condition(latest), ["condition"]),
        *lines(f"against {baseline}", audit.mcnemar_pairwise(latest, baseline), ["condition"]),
        *lines("by body system", audit.mcnemar_by_stratum(latest, baseline), ["body_system"]),
        *lines("discordant pairs", audit.discordant_pairs(latest), ["cond_a", "cond_b"]),
    ]


def coverage_report(latest: DataFrame, cov: DataFrame, baseline: str = audit.BASELINE, examples: int = 7) -> list[str]:
    sample = cov.where("covered").orderBy("qid").limit(examples).select("qid", "match_strategy", "matched_uid", "matched_dx", "gold_text")
    return [
        *lines("coverage", coverage.coverage_summary(cov), ["match_strategy"]),
        *lines("by body system", coverage.coverage_by_system(cov), [F.desc("total"), "body_system"]),
        *lines("accuracy", coverage.accuracy_by_coverage(latest, cov), ["condition", "subset"]),
        *lines("covered questions against the baseline", coverage.mcnemar_covered(latest, cov, baseline), ["condition"]),
        *lines("examples", sample, ["qid"]),
    ]


def contamination_report(pairs: DataFrame, quartiles: DataFrame, verdict: DataFrame, duplicate, examples: int = 20) -> list[str]:
    return [*lines("distances", quartiles, ["correct", "hash"]), *lines("likely duplicates", pairs.where(duplicate).orderBy("qid").limit(examples), ["qid"]), *lines("verdict", verdict, ["verdict"])]
