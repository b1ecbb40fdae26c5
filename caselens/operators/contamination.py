"""Near-duplicate images between questions and the cases retrieved for them, by perceptual hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselens.functions.vectors import hamming

BITS = 64


def nearest_pair(records: DataFrame, question_images: DataFrame, case_images: DataFrame, top_k: int = 3) -> DataFrame:
    """qid, correct, min_ahash, min_dhash, best_case, best_q_path, best_case_img of every record.

    ``records``: qid, correct, sources (array of structs with u_id). ``question_images``: qid, q_pos, path, ahash, dhash.
    ``case_images``: u_id, img_pos, path, ahash, dhash. Of all pairs of a question's images and those of its first
    ``top_k`` sources the one with the least sum of both distances counts, the first of equals; without a pair under the
    greatest sum both are 64.
    """
    shown = F.slice(F.coalesce(F.col("sources"), F.expr("array()").cast(records.schema["sources"].dataType)), 1, top_k)
    sources = records.select("qid", F.posexplode(shown).alias("s_pos", "s")).select("qid", "s_pos", F.col("s.u_id").alias("u_id"))
    of_case = case_images.select("u_id", "img_pos", F.col("path").alias("c_path"), F.col("ahash").alias("ca"), F.col("dhash").alias("cd"))
    of_question = question_images.select("qid", "q_pos", F.col("path").alias("q_path"), F.col("ahash").alias("qa"), F.col("dhash").alias("qd"))
    pairs = sources.join(of_case, "u_id").join(of_question, "qid")
    a, d = hamming(F.col("qa"), F.col("ca")), hamming(F.col("qd"), F.col("cd"))
    scored = pairs.select("qid", "u_id", "q_path", "c_path", "q_pos", "s_pos", "img_pos", a.alias("a"), d.alias("d")).where(F.col("a") + F.col("d") < 2 * BITS)
    best = scored.groupBy("qid").agg(F.min_by(F.struct("a", "d", "u_id", "q_path", "c_path"), F.struct(F.col("a") + F.col("d"), "q_pos", "s_pos", "img_pos")).alias("m"))
    return records.join(best, "qid", "left").select(
        "qid",
        "correct",
        F.coalesce("m.a", F.lit(BITS)).cast("int").alias("min_ahash"),
        F.coalesce("m.d", F.lit(BITS)).cast("int").alias("min_dhash"),
        F.col("m.u_id").alias("best_case"),
        F.col("m.q_path").alias("best_q_path"),
        F.col("m.c_path").alias("best_case_img"),
    )


def likely_duplicate(ahash: int = 10, dhash: int = 10) -> Column:
    return (F.col("min_ahash") <= ahash) & (F.col("min_dhash") <= dhash)


def order_statistics(df: DataFrame, by: list[str], col: str) -> DataFrame:
    """min, x[n/4], x[n/2], x[3n/4], max of a small-range integer column, places rounded down, nothing interpolated.

    Counted by value, so a group is never collected: as many rows as there are values reach a task.
    """
    counts = df.groupBy(*by, F.col(col).alias("v")).agg(F.count("*").alias("n"))
    run = counts.groupBy(*by).agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("v", "n"))).alias("h"))
    upto = F.transform("h", lambda x, i: F.struct(x["v"].alias("v"), F.aggregate(F.slice("h", F.lit(1), i + 1), F.lit(0).cast("long"), lambda s, y: s + y["n"]).alias("upto")))
    run = run.withColumn("h", upto)

    def at(place: Column) -> Column:
        return F.get(F.filter("h", lambda x: x["upto"] > place), F.lit(0))["v"]

    n = F.col("n")
    return run.select(*by, "n", at(F.lit(0)).alias("least"), at(F.floor(n / 4)).alias("q25"), at(F.floor(n / 2)).alias("median"), at(F.floor(3 * n / 4)).alias("q75"), at(n - 1).alias("most"))


def verdict(pairs: DataFrame, ahash: int = 10, dhash: int = 10) -> DataFrame:
    """Likely duplicates among right and wrong answers, and what follows from them."""
    dup = likely_duplicate(ahash, dhash)
    sums = pairs.agg(
        F.count_if(F.col("correct")).alias("n_correct"),
        F.count_if(~F.col("correct")).alias("n_wrong"),
        F.count_if(F.col("correct") & dup).alias("dup_correct"),
        F.count_if(~F.col("correct") & dup).alias("dup_wrong"),
    )
    sums = sums.withColumn("p_c", F.coalesce(F.try_divide("dup_correct", "n_correct"), F.lit(0.0))).withColumn("p_w", F.coalesce(F.try_divide("dup_wrong", "n_wrong"), F.lit(0.0)))
    said = F.when(F.col("n_correct") == 0, "none").when(F.col("p_c") > 3 * F.greatest("p_w", F.lit(1e-3)), "likely").when((F.col("p_c") < 0.1) & (F.col("p_w") < 0.1), "unlikely").otherwise("modest")
    return sums.select("n_correct", "n_wrong", "dup_correct", "dup_wrong", F.round("p_c", 6).alias("p_correct"), F.round("p_w", 6).alias("p_wrong"), said.alias("verdict"))
