"""The evaluation run: retrieve once a question, build the prompts of every condition, generate, score."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselens.session import checkpointed

from . import generation, prompts, retrieval
from .embedding import embed

_DOC = "struct<rank:int,u_id:string,similarity:double,text:string,image_paths:array<string>>"


def retrieve(questions: DataFrame, collection: dict[str, DataFrame], k: int = 3, embedder: Callable | None = None) -> DataFrame:
    """id, docs: the ``k`` best documents of each question in order, with their texts and images."""
    asked = questions.select(F.col("id").alias("qid"), "question")
    if embedder is not None and "vectors" in collection:
        asked = embed(asked, "question", embedder)
    else:
        collection = {name: df for name, df in collection.items() if name != "vectors"}
    found = retrieval.search_collection(collection, asked, k)
    texts = collection["documents"].select(F.col("id").alias("u_id"), "text", F.transform("modalities", lambda m: m["value"]).alias("image_paths"))
    docs = found.join(texts, "u_id").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "u_id", "similarity", "text", "image_paths"))).alias("docs"))
    return docs.withColumnRenamed("qid", "id")


def run(questions: DataFrame, retrieved: DataFrame | None, model: Callable, conditions: list[str] | None = None, max_images: int = 12, max_retrieved: int = 20, batch: int = 64) -> DataFrame:
    """A record a question and condition: predictions of all parsers, what was shown and where it came from.

    ``retrieved`` (id, docs) is read for all conditions, also where nothing of it is shown; None if no condition retrieves.
    """
    q = questions.select("id", F.coalesce("question", F.lit("")).alias("question"), "label", "image_paths", *[F.coalesce(c, F.lit("")).alias(c) for c in ("body_system", "medical_task", "question_type")])
    none = F.array().cast(f"array<{_DOC}>")
    q = q.withColumn("docs", none) if retrieved is None else q.join(retrieved, "id", "left").withColumn("docs", F.coalesce("docs", none))
    q = q.withColumns({"context": prompts.format_context(F.col("docs")), "retrieved_paths": prompts.attachments(F.col("docs"), max_retrieved)})
    shown = prompts.prompt_inputs(prompts.fan_out(q, conditions), max_images).withColumn("prompt", F.to_json(prompts.messages(F.col("user_content"))))
    said = generation.generate(shown.select("id", "condition", "prompt", "prompt_images"), model, batch=batch).select("id", "condition", "raw_output")
    # outputs meet their records by key, and what a model said is not asked for twice
    scored = generation.score_outputs(shown.join(checkpointed(said), ["id", "condition"]).withColumn("gold", F.col("label")))
    sources = F.transform("docs", lambda d: F.struct(d["u_id"].alias("u_id"), d["rank"].alias("rank"), d["similarity"].alias("similarity"), F.size(F.coalesce(d["image_paths"], F.array().cast("array<string>"))).alias("n_attached_images")))
    parsers = generation.PARSERS
    return scored.select(
        F.col("id").alias("qid"), "condition", "gold", "predicted", "correct", "primary_parser", *[f"predicted_{p}" for p in parsers], *[f"correct_{p}" for p in parsers], "raw_output",
        "body_system", "medical_task", "question_type", F.size(F.coalesce("image_paths", F.array().cast("array<string>"))).alias("n_question_images"), "n_retrieved_images", "ctx_chars", sources.alias("sources"),
    )


def first_option() -> Callable:
    """A model for trying things out: it answers with the first option letter in brackets that the prompt names, else A."""

    def model(texts: list[str], images: list[list[str]]) -> list[str]:
        return [f"\\boxed{{{m[1] if (m := re.search(r'[(]([A-J])[)]', t)) else 'A'}}}" for t in texts]

    return model
