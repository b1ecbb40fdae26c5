"""Contexts, image budgets and prompts of the experimental conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The conditions and the system prompt.
CONDITIONS = ["no-rag", "use_vision-off", "use_vision-on"]
SYSTEM_PROMPT = (
    "You are answering a multiple-choice medical question. The user will show you one or more medical images and a clinical question, and may "
    "include reference cases (similar medical cases retrieved from a teaching-file corpus, each with an image and/or a clinical description). "
    "Please reason step by step, and put the final answer in \\boxed{X} where X is the single letter (A through J) of the chosen option."
)
#: The headings of the question's and the context's block.
QUESTION_HEAD, CONTEXT_HEAD = "Question:\n", "\n\nReference cases (text):\n"
_PART = "struct<type:string,text:string>"


def format_context(docs: Column) -> Column:
    """Numbered texts parted by blank lines, of an array of structs with rank and text; a missing rank is the place."""
    return F.array_join(F.transform(docs, lambda d, i: F.concat(F.lit("["), F.coalesce(d["rank"], i + 1).cast("string"), F.lit("] "), d["text"])), "\n\n")


def attachments(docs: Column, cap: int = 20, distinct: bool = True) -> Column:
    """The image paths of the retrieved documents in order, at most ``cap``."""
    flat = F.flatten(F.transform(docs, lambda d: F.coalesce(d["image_paths"], F.array().cast("array<string>"))))
    return F.slice(F.array_distinct(flat) if distinct else flat, 1, cap)


def user_content(question: Column, context: Column, n_question: Column, n_retrieved: Column) -> Column:
    """Image placeholders of the question, the text block, placeholders of the retrieved images."""
    image = F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text")).cast(_PART)
    text = F.concat(F.lit(QUESTION_HEAD), question, F.coalesce(F.concat(F.lit(CONTEXT_HEAD), F.nullif(context, F.lit(""))), F.lit("")))
    block = F.struct(F.lit("text").alias("type"), text.alias("text")).cast(_PART)
    return F.concat(F.array_repeat(image, n_question), F.array(block), F.array_repeat(image, n_retrieved))


def messages(content: Column) -> Column:
    """System and user turn as one JSON text each."""
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(SYSTEM_PROMPT).alias("content")), F.struct(F.lit("user").alias("role"), F.to_json(content).alias("content")))


def fan_out(questions: DataFrame, conditions: list[str] | None = None) -> DataFrame:
    """Every question once a condition; a narrow operation."""
    return questions.withColumn("condition", F.explode(F.array(*map(F.lit, conditions or CONDITIONS))))


def prompt_inputs(df: DataFrame, max_images: int = 12) -> DataFrame:
    """Add user_content, prompt_images, ctx_chars and n_retrieved_images by condition.

    ``df`` has question, image_paths, context, retrieved_paths and condition. Without retrieval there is neither
    context nor retrieved image; with vision the question's images come first, whole, and retrieved ones fill up
    what the budget leaves. Placeholders count all the question's images, also where the list was cut.
    """
    none = F.array().cast("array<string>")
    own, got = F.coalesce(F.col("image_paths"), none), F.coalesce(F.col("retrieved_paths"), none)
    context = F.when(F.col("condition") == "no-rag", F.lit(None)).otherwise(F.nullif(F.col("context"), F.lit("")))
    room = F.greatest(F.lit(0), max_images - F.size(own))
    extra = F.when(F.col("condition") == "use_vision-on", F.slice(got, F.lit(1), room)).otherwise(none)
    images = F.when(F.col("condition") == "use_vision-on", F.concat(own, extra)).otherwise(F.slice(own, 1, max_images))
    return df.select(
        *df.columns,
        user_content(F.col("question"), context, F.size(own), F.size(extra)).alias("user_content"),
        images.alias("prompt_images"),
        F.coalesce(F.length(context), F.lit(0)).alias("ctx_chars"),
        F.size(extra).alias("n_retrieved_images"),
    )
