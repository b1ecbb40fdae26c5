"""Running accuracy over records as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselens.operators.records import correctness


def accuracy_by_window(records: DataFrame, time_col: str = "finished_at", window: str = "1 day", delay: str | None = None, field: str = "correct_boxed") -> DataFrame:
    """window_start, condition, total, correct: records by the time they finished, however late they come.

    A stream of records or a table of them, with the same result; the state holds a row a window and condition. With a
    ``delay`` a stream forgets windows that are older, as append mode needs, and drops what comes later still.
    """
    hit = correctness(records, field).cast("long")
    timed = records.where(F.col(time_col).isNotNull()).select(F.col(time_col).alias("t"), "condition", hit.alias("hit"))
    if records.isStreaming and delay:
        timed = timed.withColumn("t", F.col("t").cast("timestamp")).withWatermark("t", delay)  # a watermark needs a zone
    out = timed.groupBy(F.window("t", window).alias("w"), "condition").agg(F.count("*").alias("total"), F.sum("hit").alias("correct"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "condition", "total", "correct")


def distinct_records(records: DataFrame, key: list[str], time_col: str = "ingested_at", delay: str = "30 days") -> DataFrame:
    """The first of equal records of a stream, remembered for ``delay``."""
    if not records.isStreaming:
        return records.dropDuplicates(key)
    timed = records.withColumn(time_col, F.col(time_col).cast("timestamp"))
    return timed.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(key)
