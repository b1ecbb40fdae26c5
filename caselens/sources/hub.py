"""Snapshots of published datasets: a folder of parquet or JSON-lines files whose names begin with their split."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import read_jsonl, read_parquet

#: The order in which splits come, others after them by name.
ORDER = ["train", "validation", "test"]
_NAME = re.compile(r"/([^/]+?)(?:-\d{5}-of-\d{5})?\.(parquet|jsonl)$")


def splits(spark: SparkSession, folder: str) -> dict[str, list[str]]:
    """The files of each split, in order; only names are read, and there are as many as files."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    out: dict[str, list[str]] = {}
    for r in listing.where(F.col("path").rlike(r"\.(parquet|jsonl)$")).orderBy("path").collect():
        if m := _NAME.search(r["path"]):
            out.setdefault(m[1], []).append(r["path"])
    return dict(sorted(out.items(), key=lambda x: (ORDER.index(x[0]) if x[0] in ORDER else len(ORDER), x[0])))


def read_split(spark: SparkSession, folder: str, schema: str | None = None, split: str | None = None) -> DataFrame:
    """One split with its ``_pos``; the first one if none is named. JSON lines need the ``schema``."""
    found = splits(spark, folder)
    name = split or next(iter(found), None)
    if name not in found:
        raise ValueError(f"{folder} has no split {name!r}, only {sorted(found)}")
    files = found[name]
    return read_parquet(spark, files, "_pos") if files[0].endswith(".parquet") else read_jsonl(spark, files, schema)
