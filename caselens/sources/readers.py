"""Readers that keep the order of the rows in a position column."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselens.functions.text import SPACE

from . import png


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str, skip_blank: bool = True, position: str | None = "_pos") -> DataFrame:
    """JSON lines under a schema. Blank lines are skipped; any other line that is no object fails the read.

    ``position`` is a struct that orders the rows by file name, split and line, however the files were packed into tasks.
    """
    lines = spark.read.text(path)
    if position:
        # a split is read by one task from its first line on, so the running number orders the lines within it
        at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
        lines = lines.select("value", at.alias(position))
    if skip_blank:
        lines = lines.where(F.regexp_replace("value", f"[{SPACE}]+", "") != "")
    parsed = lines.select(*([position] if position else []), F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r"))
    return parsed.select("r.*", *([position] if position else []))


def read_parquet(spark: SparkSession, path: str | list[str], position: str | None = None) -> DataFrame:
    """Parquet files; ``position`` orders the rows by file name and row."""
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    if not position:
        return df
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.lit(0).cast("long").alias("block"), F.col("_metadata.row_index").alias("row"))
    return df.select("*", at.alias(position))


def image_listing(spark: SparkSession, folder: str, pattern: str = "*.png") -> DataFrame:
    """Paths of the images that exist below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select(F.regexp_replace("path", "^file:(//)?", "").alias("path"))


def existing(df: DataFrame, path_col: str, listing: DataFrame) -> DataFrame:
    """Rows whose file exists."""
    return df.join(listing.select(F.col("path").alias(path_col)).distinct(), path_col, "left_semi")


def read_images(spark: SparkSession, folder: str, pattern: str = "*.png", max_bytes: int = 256 << 20) -> DataFrame:
    """path, content of the images below a folder; files beyond ``max_bytes`` are refused with a null content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select(F.regexp_replace("path", "^file:(//)?", "").alias("path"), F.when(F.col("length") <= max_bytes, F.col("content")).alias("content"))


def read_contents(paths: DataFrame, path_col: str = "path", max_bytes: int = 256 << 20) -> DataFrame:
    """path, content, error of each distinct path of a folder that all executors share; only these files are opened.

    A file that is missing, can't be read or is larger than ``max_bytes`` has a null content and an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                content, error = None, None
                try:
                    with open(path, "rb") as f:
                        content = f.read(max_bytes + 1)
                    if len(content) > max_bytes:
                        content, error = None, "larger than allowed"
                except OSError as e:
                    error = type(e).__name__
                yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([content], pa.binary()), pa.array([error], pa.string())], names=["path", "content", "error"])

    needed = paths.select(F.col(path_col).cast("string").alias("path")).where("path is not null").distinct()
    return needed.mapInArrow(run, "path string, content binary, error string")


def load_images(df: DataFrame, paths_col: str, key_cols: list[str], cap: int) -> DataFrame:
    """``key_cols``, images: the contents of the first ``cap`` paths of each row in order, files that can't be read left out."""
    each = df.select(*key_cols, F.posexplode(F.slice(paths_col, 1, cap)).alias("i", "path"))
    met = each.join(read_contents(each).where("content is not null").select("path", "content"), "path")
    images = met.groupBy(*key_cols).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "content"))), lambda x: x["content"]).alias("images"))
    return df.select(*key_cols).join(images, key_cols, "left").withColumn("images", F.coalesce("images", F.array().cast("array<binary>")))


def decoded(images: DataFrame, sizes: list[tuple[int, int]], decode: Callable[[bytes, list[tuple[int, int]]], list[list[float]]] | None = None) -> DataFrame:
    """path, pixels, error: the grey thumbnails of each size from one decoding; of an image that can't be decoded the error.

    ``decode`` turns bytes into the grey values of every size; without it ``pillow_decode``.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        use = decode or pillow_decode
        for f in frames:
            rows = []
            for path, content in zip(f["path"], f["content"]):
                try:
                    rows.append((path, [[float(x) for x in p] for p in use(bytes(content), sizes)], None))
                except Exception as e:  # noqa: BLE001 - a broken image is skipped, whatever breaks it
                    rows.append((path, None, type(e).__name__))
            yield pd.DataFrame(rows, columns=["path", "pixels", "error"])

    return images.where("content is not null").select("path", "content").mapInPandas(run, "path string, pixels array<array<double>>, error string")


def thumbnails(images: DataFrame, width: int, height: int, decode: Callable[[bytes, int, int], list[float]] | None = None) -> DataFrame:
    """path, pixels: grey thumbnails of one size; an image that can't be decoded gives no row."""
    got = decoded(images, [(width, height)], decode and (lambda content, sizes: [decode(content, *sizes[0])]))
    return got.where("error is null").select("path", F.col("pixels")[0].alias("pixels"))


def pillow_decode(content: bytes, sizes: list[tuple[int, int]]) -> list[list[float]]:
    """Grey thumbnails by Lanczos resampling: by Pillow, or of PNG files without it where it is not installed."""
    import io

    try:
        from PIL import Image
    except ModuleNotFoundError:
        return png.thumbnails(content, sizes)

    with Image.open(io.BytesIO(content)) as image:
        grey = image.convert("L")
        return [list(grey.resize(size, Image.Resampling.LANCZOS).getdata()) for size in sizes]


def rgb_png(content: bytes) -> bytes:
    """An image as an RGB PNG: by Pillow, or of a PNG without it where it is not installed."""
    import io

    try:
        from PIL import Image
    except ModuleNotFoundError:
        return png.rgb_png(content)

    out = io.BytesIO()
    with Image.open(io.BytesIO(content)) as image:
        image.convert("RGB").save(out, format="PNG")
    return out.getvalue()
