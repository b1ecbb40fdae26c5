"""Case corpus: one text a case from its fields, and documents with their images attached."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselens.functions.text import SPACE, strip

#: Headings and fields of a case text, in order. Fixed values.
PLAIN_FIELDS = [("Modality", "modality"), ("Plane", "plane"), ("Location", "location")]
LONG_FIELDS = [("History", "history"), ("Exam", "exam"), ("Findings", "findings"), ("Discussion", "disease_discussion")]
NO_VALUE = "N/A"


def case_text() -> Column:
    """The fields of a case row as one text, a line a field; empty fields, repeats and N/A left out."""
    v = {f: strip(F.coalesce(F.col(f).cast("string"), F.lit(""))) for f in ("title", "case_diagnosis", "differential_diagnosis", "age", "sex", *[f for _, f in PLAIN_FIELDS + LONG_FIELDS])}

    def line(head: str, value: Column, show: Column) -> Column:
        return F.when(show, F.concat(F.lit(f"{head}: "), value))

    or_unknown = lambda c: F.when(c != "", c).otherwise("?")
    patient = F.when((v["age"] != "") | (v["sex"] != ""), F.concat(F.lit("Patient: "), or_unknown(v["age"]), F.lit("yo "), or_unknown(v["sex"])))
    return F.concat_ws(
        "\n",
        line("Diagnosis", v["title"], v["title"] != ""),
        line("Case diagnosis", v["case_diagnosis"], (v["case_diagnosis"] != "") & (v["case_diagnosis"] != v["title"])),
        line("Differential", v["differential_diagnosis"], (v["differential_diagnosis"] != "") & (v["differential_diagnosis"] != v["case_diagnosis"])),
        *[line(h, v[f], v[f] != "") for h, f in PLAIN_FIELDS],
        patient,
        *[line(h, v[f], (v[f] != "") & (v[f] != NO_VALUE)) for h, f in LONG_FIELDS],
    )


def image_file(uid: Column, index: Column) -> Column:
    """File name of a case image."""
    return F.format_string("%s_%02d.png", uid, index)


def is_blank(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]+", "") == ""


def images_by_case(cases: DataFrame) -> DataFrame:
    """u_id, image_paths: the distinct images of a case, by index and path; rows without a path left out."""
    images = cases.where("image_path is not null").select("u_id", "image_idx", "image_path").distinct()
    return images.groupBy("u_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("image_idx", "image_path"))), lambda x: x["image_path"]).alias("image_paths"))


def documents(texts: DataFrame, cases: DataFrame) -> DataFrame:
    """One document a case with text: id, text, modalities, metadata. Cases without images stay; blank texts go.

    ``texts`` has a row a case: u_id, text.
    """
    images = images_by_case(cases)
    with_images = texts.where(~is_blank(F.col("text"))).join(images, "u_id", "left").withColumn("image_paths", F.coalesce("image_paths", F.array().cast("array<string>")))
    return with_images.select(
        F.col("u_id").alias("id"),
        F.col("u_id").alias("document_id"),
        "text",
        F.transform("image_paths", lambda p: F.struct(F.lit("image").alias("type"), p.alias("value"))).alias("modalities"),
        F.struct("u_id", F.size("image_paths").alias("n_images")).alias("metadata"),
    )
