"""Writers."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines with explicit nulls; any script is written as it is."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: list[str] | None = None) -> None:
    """Parquet compressed with zstd."""
    writer = df.write.mode(mode).option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_images(images: DataFrame, folder: str, convert: Callable[[bytes], bytes] | None = None) -> int:
    """Write name, content rows as files of a shared folder, ``convert``-ed first (``readers.rgb_png``); a file that exists is left
    alone. The number written.

    Each file appears under its name only when whole, so a task that is run again does no harm.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        os.makedirs(folder, exist_ok=True)
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                target = os.path.join(folder, os.path.basename(name))
                if content is not None and not os.path.exists(target):
                    part = f"{target}.{os.getpid()}.part"
                    with open(part, "wb") as f:
                        f.write(convert(content) if convert else content)
                    os.replace(part, target)
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return images.select("name", "content").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def write_summary(path: str, head: dict, by_condition: DataFrame, by_parser: DataFrame, by_system: DataFrame) -> dict:
    """The summary of a run as one JSON document. The three frames have a row a condition, parser or body system."""
    out: dict = dict(head)
    out["by_condition"] = {r["condition"]: {"total": r["total"], "correct": r["correct"], "accuracy": r["accuracy"], "by_parser": {}} for r in by_condition.orderBy("condition").collect()}
    for r in by_parser.orderBy("condition", "parser").collect():
        out["by_condition"][r["condition"]]["by_parser"][r["parser"]] = {k: r[k] for k in ("correct", "accuracy", "null_pred")}
    out["by_condition_x_body_system"] = {r["key"]: {"correct": r["correct"], "total": r["total"]} for r in by_system.orderBy("key").collect()}
    Path(path).write_text(json.dumps(out, indent=2, ensure_ascii=False))
    return out


def write_collection(documents: DataFrame, postings: DataFrame, terms: DataFrame, path: str, models: dict[str, str], vectors: DataFrame | None = None) -> None:
    """An index as a folder: documents, inverted index, terms, dense vectors, and the names of the models."""
    write_parquet(documents, f"{path}/documents", "overwrite")
    write_parquet(postings.repartition("term"), f"{path}/postings", "overwrite")
    write_parquet(terms, f"{path}/terms", "overwrite")
    if vectors is not None:
        write_parquet(vectors, f"{path}/vectors", "overwrite")
    documents.sparkSession.createDataFrame(sorted(models.items()), "kind string, model string").coalesce(1).write.mode("overwrite").json(f"{path}/models")


def open_collection(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """documents, postings and terms of an index folder, and its vectors and the names of its models."""
    out = {name: spark.read.parquet(f"{path}/{name}") for name in ("documents", "postings", "terms")}
    out["models"] = spark.read.schema("kind string, model string").json(f"{path}/models")
    try:
        out["vectors"] = spark.read.parquet(f"{path}/vectors")
    except AnalysisException:  # an index of terms alone
        pass
    return out


def spot_check(collection: dict[str, DataFrame], n: int = 3) -> list[dict]:
    """A few documents of a collection with their attachments, to look at."""
    return [r.asDict(recursive=True) for r in collection["documents"].limit(n).collect()]
