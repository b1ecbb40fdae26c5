"""Scores and paired tests over evaluation records (qid, condition, ok, body_system)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselens.functions.parsers import PARSERS
from caselens.functions.stats import mcnemar, wilson, with_holm

from .records import correctness, last_per_key

BASELINE = "no-rag"


def latest_records(results: DataFrame, field: str = "correct_boxed", pos: str = "pos") -> DataFrame:
    """qid, condition, ok, body_system of the last record of each question and condition."""
    slim = results.select("qid", "condition", pos, correctness(results, field).alias("ok"), F.coalesce("body_system", F.lit("")).alias("body_system"))
    return last_per_key(slim, ["qid", "condition"], pos).drop(pos)


def score_by_condition(records: DataFrame) -> DataFrame:
    """Total, correct and accuracy of each condition, over all records given."""
    out = records.groupBy("condition").agg(F.count("*").alias("total"), F.sum(correctness(records).cast("long")).alias("correct"))
    return out.withColumn("accuracy", F.round(F.try_divide("correct", "total"), 6))


def score_by_parser(records: DataFrame) -> DataFrame:
    """Correct answers, accuracy and null predictions of each condition and parser: one pass, the parsers unpivoted after it."""
    sums = [F.sum(F.coalesce(F.col(f"correct_{p}"), F.lit(False)).cast("long")).alias(f"c_{p}") for p in PARSERS] + [F.count_if(F.col(f"predicted_{p}").isNull()).alias(f"n_{p}") for p in PARSERS]
    wide = records.groupBy("condition").agg(F.count("*").alias("total"), *sums)
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("parser"), F.col(f"c_{p}").alias("correct"), F.col(f"n_{p}").alias("null_pred")) for p in PARSERS]))
    return wide.select("condition", "total", each.alias("x")).select("condition", "x.parser", "total", "x.correct", "x.null_pred", F.round(F.try_divide("x.correct", "total"), 6).alias("accuracy"))


def score_by_condition_and_system(records: DataFrame) -> DataFrame:
    """Correct and total of each condition and body system under the key ``condition::system``."""
    key = F.concat("condition", F.lit("::"), F.coalesce("body_system", F.lit("")))
    return records.groupBy(key.alias("key")).agg(F.sum(correctness(records).cast("long")).alias("correct"), F.count("*").alias("total"))


def wilson_by_condition(latest: DataFrame) -> DataFrame:
    """k, n, accuracy and Wilson interval of each condition."""
    counts = latest.groupBy("condition").agg(F.sum(F.col("ok").cast("long")).alias("k"), F.count("*").alias("n"))
    p, low, high = wilson(F.col("k"), F.col("n"))
    return counts.select("condition", "k", "n", F.round(p, 6).alias("accuracy"), F.round(low, 6).alias("ci_low"), F.round(high, 6).alias("ci_high"))


def _by_question(latest: DataFrame) -> DataFrame:
    """qid and the map condition -> ok: one shuffle serves every comparison."""
    return latest.groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("condition", "ok"))).alias("ok"))


def _need_baseline(latest: DataFrame, baseline: str) -> None:
    if latest.where(F.col("condition") == baseline).isEmpty():
        raise ValueError(f"there is no record of the baseline condition {baseline!r}")


def discordant_pairs(latest: DataFrame) -> DataFrame:
    """For each two conditions a < b: b (only a right), c (only b right), total, net; questions that have both."""
    maps = _by_question(latest)
    names = F.map_keys("ok")
    pairs = maps.select("ok", F.explode(names).alias("cond_a")).select("ok", "cond_a", F.explode(F.map_keys("ok")).alias("cond_b")).where("cond_a < cond_b")
    a, b = F.col("ok")[F.col("cond_a")], F.col("ok")[F.col("cond_b")]
    out = pairs.groupBy("cond_a", "cond_b").agg(F.count_if(a & ~b).alias("b"), F.count_if(~a & b).alias("c"))
    return out.withColumn("total", F.col("b") + F.col("c")).withColumn("net", F.col("c") - F.col("b"))


def mcnemar_pairwise(latest: DataFrame, baseline: str = BASELINE) -> DataFrame:
    """Every condition against the baseline: discordant pairs, chi-square, p, Holm's p, difference in percentage points."""
    _need_baseline(latest, baseline)
    rows = _by_question(latest).select("ok", F.col("ok")[baseline].alias("base"), F.explode("ok").alias("condition", "hit"))
    both = F.col("base").isNotNull()
    counts = rows.groupBy("condition").agg(
        F.count_if(both & F.col("base") & ~F.col("hit")).alias("b"),
        F.count_if(both & ~F.col("base") & F.col("hit")).alias("c"),
        F.avg(F.col("hit").cast("double")).alias("acc"),
    )
    base = counts.where(F.col("condition") == baseline).select(F.col("acc").alias("base_acc"))
    chi2, p = mcnemar(F.col("b"), F.col("c"))
    tested = counts.where(F.col("condition") != baseline).join(F.broadcast(base)).withColumn("chi2", chi2).withColumn("p_raw", p)
    out = with_holm(tested, "p_raw", ["condition"])
    tests = [F.round(c, 6).alias(c) for c in ("chi2", "p_raw", "p_holm")]
    delta = F.round((F.col("acc") - F.col("base_acc")) * 100, 6).alias("delta_pp")
    return out.select("condition", "b", "c", *tests, delta, (F.col("p_holm") < 0.05).alias("significant"))


def mcnemar_by_stratum(latest: DataFrame, baseline: str = BASELINE, target: str | None = None) -> DataFrame:
    """The baseline against ``target`` (the last other condition by name) within each body system of the baseline's
    records; blank systems are left out, and a question without a target record counts as not right there."""
    _need_baseline(latest, baseline)
    name = F.lit(target) if target else F.col("target")
    last = latest.where(F.col("condition") != baseline).agg(F.max("condition").alias("target"))
    base = latest.where((F.col("condition") == baseline) & (F.col("body_system") != "")).select("qid", "body_system", F.col("ok").alias("a"))
    other = latest.join(F.broadcast(last)).where(F.col("condition") == name).select("qid", F.col("ok").alias("b_ok"))
    joined = base.join(other, "qid", "left").withColumn("b_ok", F.coalesce("b_ok", F.lit(False)))
    counts = joined.groupBy("body_system").agg(F.count("*").alias("n"), F.count_if(F.col("a") & ~F.col("b_ok")).alias("b"), F.count_if(~F.col("a") & F.col("b_ok")).alias("c"))
    chi2, p = mcnemar(F.col("b"), F.col("c"))
    out = with_holm(counts.withColumn("chi2", chi2).withColumn("p_raw", p), "p_raw", ["body_system"])
    return out.select("body_system", "n", "b", "c", F.round("chi2", 6).alias("chi2"), F.round("p_raw", 6).alias("p_raw"), F.round("p_holm", 6).alias("p_holm"), (F.col("p_holm") < 0.05).alias("significant"))


def report_lines(wilson_rows: DataFrame) -> DataFrame:
    """One formatted line a condition."""
    return wilson_rows.select("condition", F.format_string("%s %d/%d %.4f [%.4f, %.4f]", "condition", "k", "n", "accuracy", "ci_low", "ci_high").alias("line"))
