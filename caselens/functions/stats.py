"""Statistics of paired accuracy, as Column expressions over counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Coefficients of the Chebyshev fit of erfc in Press et al., Numerical Recipes; error below 1.2e-7. Fixed values.
ERFC = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]


def erfc(x: Column) -> Column:
    """Complementary error function of a non-negative number."""
    t = 1 / (1 + x / 2)
    poly = F.lit(ERFC[-1])
    for c in ERFC[-2::-1]:
        poly = F.lit(c) + t * poly
    return t * F.exp(-x * x + poly)


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column, Column]:
    """Share, lower and upper bound of the Wilson interval; all 0 when n is 0."""
    m = F.when(n > 0, n).cast("double")
    p = k / m
    denom = 1 + z * z / m
    centre = (p + z * z / (2 * m)) / denom
    margin = z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m)) / denom
    zero = F.lit(0.0)
    return F.coalesce(p, zero), F.coalesce(F.greatest(zero, centre - margin), zero), F.when(n > 0, F.least(F.lit(1.0), centre + margin)).otherwise(zero)


def mcnemar(b: Column, c: Column) -> tuple[Column, Column]:
    """Chi-square with continuity correction and its p-value; (0, 1) without discordant pairs."""
    total = F.when(b + c > 0, b + c).cast("double")
    chi2 = F.coalesce((F.abs(b - c) - 1) * (F.abs(b - c) - 1) / total, F.lit(0.0))
    return chi2, F.when(b + c > 0, erfc(F.sqrt(chi2 / 2))).otherwise(1.0)


def with_holm(df: DataFrame, p_col: str, tie_cols: list[str], by: list[str] | None = None, out_col: str = "p_holm") -> DataFrame:
    """Add Holm's step-down adjusted p-values within each group of ``by``. A family is a handful of comparisons."""
    by = by or []
    order = Window.partitionBy(*by).orderBy(p_col, *tie_cols)
    ranked = df.withColumn("__rank", F.row_number().over(order)).withColumn("__m", F.count("*").over(Window.partitionBy(*by)))
    step = F.least(F.lit(1.0), F.col(p_col) * (F.col("__m") - F.col("__rank") + 1))
    return ranked.withColumn(out_col, F.max(step).over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__rank", "__m")
