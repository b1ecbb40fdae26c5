"""Joins that stay whole and balanced where single keys hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselens.session import local_frame

#: A key with at least one in so many of the rows is hot; so there are at most that many hot keys.
HOT_SHARE = 1_000
#: The rows of a hot key are spread over so many places of the shuffle.
SPREAD = 65_536


def hot_keys(counts: DataFrame, key: str) -> DataFrame:
    """The keys that hold at least a thousandth of all rows, of ``counts`` (key, n); collected, as there are a thousand at most."""
    total = counts.agg(F.sum("n").alias("__all"))
    hot = counts.join(F.broadcast(total)).where((F.col("n") * HOT_SHARE >= F.col("__all")) & (F.col("n") > 1)).select(key).limit(HOT_SHARE)
    return local_frame(counts.sparkSession, [tuple(r) for r in hot.collect()], f"{key} {counts.schema[key].dataType.simpleString()}")


def join_unique(many: DataFrame, one: DataFrame, key: str, how: str = "left", counts: DataFrame | None = None, hot: DataFrame | None = None) -> DataFrame:
    """Join ``many`` with ``one``, which has a row a key at most, on the column ``key``; ``how`` is left or inner.

    Keys that hold a thousandth of the rows of ``many`` or more are at most a thousand, so their rows of ``one``
    are broadcast; the rows they meet keep out of the others' way by a salt, and the rest is joined by shuffle, where no key
    is large. Rows with a null key stay in a left join, spread likewise. ``counts`` (key, n) are the rows of each key, ``hot`` the keys
    of ``hot_keys``, if they are known; ``many`` is read once for the join and once for its counts if they are not.
    """
    if hot is None:
        if counts is None:
            counts = many.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
        hot = hot_keys(counts, key)
    rest = [c for c in one.columns if c != key]
    found = F.struct(F.lit(True).alias("found"), *rest)
    hot_rows = F.broadcast(one.join(F.broadcast(hot), key).select(key, found.alias("__hot")))
    apart = F.pmod(F.xxhash64(*[c for c in many.columns if not many.schema[c].dataType.simpleString().startswith("map")], F.monotonically_increasing_id()), F.lit(SPREAD)) + 1
    marked = many.join(hot_rows, key, "left").withColumn("__salt", F.when(F.col("__hot").isNotNull() | F.col(key).isNull(), apart).otherwise(F.lit(0).cast("long")))
    cold = one.select(key, found.alias("__cold"), F.lit(0).cast("long").alias("__salt"))
    out = marked.join(cold, [key, "__salt"], "left").withColumn("__one", F.coalesce("__hot", "__cold"))
    if how == "inner":
        out = out.where("__one is not null")
    return out.select(*many.columns, *[F.col("__one")[c].alias(c) for c in rest])
