"""Order-dependent row choices, made explicit: first or last row of a key by a position column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_per_key(df: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """The row with the greatest ``pos`` of each key. Aggregated before the shuffle, so a hot key is no hot task."""
    rest = [c for c in df.columns if c not in keys]
    kept = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(pos)).alias("__r"))
    return kept.select(*keys, "__r.*").select(*df.columns)


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row that comes first by ``order`` of each key, nulls last; of equal rows one."""
    rest = [c for c in df.columns if c not in keys]
    by = F.struct(*[x for c in order for x in (F.col(c).isNull(), F.col(c))])
    kept = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), by).alias("__r"))
    return kept.select(*keys, "__r.*").select(*df.columns)


def running_index(df: DataFrame, key: str, order: list[str], out: str) -> DataFrame:
    """Number the rows of each key from 0 in the given order."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)


def correctness(df: DataFrame, field: str = "correct_boxed", fallback: str = "correct") -> Column:
    """The chosen score, else the fallback, else false."""
    return F.coalesce(F.col(field), F.col(fallback), F.lit(False))


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows of distinct keys without replacement, in a random order given by ``rank`` from 1.

    The order is that of a keyed hash, so it holds on any cluster. Top-n of each partition is cut before rows move.
    """
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    top = df.withColumn("__o", order).orderBy("__o", key).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy("__o", key))).drop("__o")


def numbered(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """Number all rows from 0 in the given order: sorted by ranges, then each range by its place after the ranges before it.

    Only the row count of each range comes to the driver.
    """
    from caselens.session import checkpointed, local_frame

    ranges = checkpointed(df.orderBy(*order).select("*", F.spark_partition_id().alias("__p"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("__i")))
    sizes, start, rows = sorted((r["__p"], r["count"]) for r in ranges.groupBy("__p").count().collect()), 0, []
    for part, n in sizes:
        rows.append((part, start))
        start += n
    at = local_frame(df.sparkSession, rows, "__p int, __start long")
    return ranges.join(F.broadcast(at), "__p").withColumn(out, F.col("__start") + F.col("__i")).drop("__p", "__i", "__start")


def indexed_sample(df: DataFrame, pos: str, n: int, seed: int = 42) -> DataFrame:
    """The sample that Python's ``random.Random(seed).sample`` draws of the rows numbered 0.. by ``pos``; ``rank`` is its order.

    Drawn on the driver: ``n`` positions, not rows.
    """
    import random

    from caselens.session import local_frame

    total = df.count()
    drawn = random.Random(seed).sample(range(total), min(n, total))
    at = local_frame(df.sparkSession, [(p, i + 1) for i, p in enumerate(drawn)], f"{pos} long, rank int")
    return df.join(F.broadcast(at) if n <= 1_000_000 else at, pos)
