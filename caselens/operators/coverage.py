"""Which gold answers the corpus covers: by substring, else by shared words."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caselens.functions.stats import wilson
from caselens.functions.text import concept_tokens, normalise, token_set_ratio

from .audit import BASELINE, mcnemar_pairwise
from .records import first_per_key

GRAM = 4


def gold_texts(questions: DataFrame) -> DataFrame:
    """qid, gold_text, body_system of each distinct question; null where the label names no option."""
    gold = F.try_element_at("options", "label")
    rows = questions.select(F.col("id").alias("qid"), gold.alias("gold_text"), F.coalesce("body_system", F.lit("")).alias("body_system"))
    return first_per_key(rows, ["qid"], ["gold_text", "body_system"])


def _grams(text):
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - GRAM + 1), lambda i: F.substring(text, i, GRAM)))


def substring_pairs(needles: DataFrame, hays: DataFrame) -> DataFrame:
    """(n, h) of every normalised needle of at least four characters that lies in a normalised hay.

    A hay that holds a needle holds every four-character gram of it, so the needle's rarest gram is looked up in the
    hays' inverted gram index: an equi-join instead of a nested loop over all pairs. Both sides are distinct texts.
    """
    hay_grams = hays.where(F.length("h") >= GRAM).select("h", F.explode(_grams(F.col("h"))).alias("g"))
    df = hay_grams.groupBy("g").agg(F.count("*").alias("df"))
    needle_grams = needles.where(F.length("n") >= GRAM).select("n", F.explode(_grams(F.col("n"))).alias("g"))
    # a gram in no hay rules the needle out, and is the rarest
    rarest = needle_grams.join(df, "g", "left").groupBy("n").agg(F.min_by("g", F.struct(F.coalesce("df", F.lit(0)).alias("df"), "g")).alias("g"))
    return rarest.join(hay_grams, "g").where(F.col("h").contains(F.col("n"))).select("n", "h")


def _rarest_words(texts: DataFrame, text: str, words: str, other: DataFrame, threshold: int) -> DataFrame:
    """``text``, w: of each text's words so many of those least used on the other side that any text which shares
    ``threshold`` percent of them has one of these."""
    df = other.groupBy("w").agg(F.count("*").alias("df"))
    each = texts.select(text, F.size(words).alias("size"), F.explode(words).alias("w")).join(df, "w", "left")
    ranked = each.groupBy(text, "size").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "w"))).alias("ws"))
    shared = F.ceil(F.col("size") * threshold / 100)
    return ranked.select(text, F.explode(F.slice("ws", F.lit(1), (F.col("size") - shared + 1).cast("int"))).alias("x")).select(text, "x.w")


def fuzzy_best(needles: DataFrame, hays: DataFrame, threshold: int = 90) -> DataFrame:
    """n, h, score of every two distinct texts whose token-set percent is at least ``threshold``.

    The percent is of the smaller set, so that set has all but a few of its words in the other: some of any few more are shared. Its rarest
    ones are looked up, once with the needles as the smaller sets and once with the hays: an equi-join that loses nothing
    and does not meet common words.
    """
    a = needles.select("n", concept_tokens(F.col("n")).alias("nt")).where(F.size("nt") > 0)
    b = hays.select("h", concept_tokens(F.col("h")).alias("ht")).where(F.size("ht") > 0)
    aw, bw = a.select("n", F.explode("nt").alias("w")), b.select("h", F.explode("ht").alias("w"))
    pairs = _rarest_words(a, "n", "nt", bw, threshold).join(bw, "w").select("n", "h").unionByName(_rarest_words(b, "h", "ht", aw, threshold).join(aw, "w").select("n", "h")).distinct()
    sized = pairs.join(a, "n").join(b, "h")
    return sized.select("n", "h", token_set_ratio(F.col("nt"), F.col("ht")).alias("score")).where(F.col("score") >= threshold)


def coverage(questions: DataFrame, cases: DataFrame, threshold: int = 90) -> DataFrame:
    """qid, covered, match_strategy, matched_uid, matched_dx, gold_text, body_system of every question.

    ``cases`` has a row a case: u_id, title, case_diagnosis, and ``case_pos``, its place in the corpus. The first case
    wins: of those that hold the gold text, else of those with the best word score of at least ``threshold``. Gold texts
    of less than four characters or without a concept word are non-matchable.
    """
    gold = gold_texts(questions).withColumn("n", normalise(F.col("gold_text")))
    matchable = (F.length("n") >= 4) & (F.size(concept_tokens(F.col("gold_text"))) > 0)
    case = cases.select("case_pos", "u_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("case_diagnosis", F.lit("")).alias("dx"))
    each = F.explode(F.array(normalise(F.col("title")), normalise(F.col("dx")))).alias("h")
    sides = case.select("case_pos", "u_id", "title", "dx", each).where("h <> ''")
    hays = sides.select("h").distinct()
    needles = gold.where(matchable).select("n").distinct()
    first = sides.groupBy("h").agg(F.min_by(F.struct("case_pos", "u_id", "title", "dx"), "case_pos").alias("case"))
    sub = substring_pairs(needles, hays).join(first, "h").groupBy("n").agg(F.min("case").alias("case"))
    sub = sub.select("n", F.lit("substring").alias("match_strategy"), F.col("case.u_id").alias("matched_uid"), F.when(F.col("case.dx") != "", F.col("case.dx")).otherwise(F.col("case.title")).alias("matched_dx"))
    rest = needles.join(sub, "n", "left_anti")
    fuzzy = fuzzy_best(rest, hays, threshold).join(first, "h")
    best = fuzzy.groupBy("n").agg(F.min(F.struct((-F.col("score")).alias("neg"), F.col("case.case_pos").alias("case_pos"))).alias("b")).select("n", (-F.col("b.neg")).alias("score"), F.col("b.case_pos").alias("case_pos"))
    both = best.join(case, "case_pos")
    s1 = token_set_ratio(concept_tokens(F.col("n")), concept_tokens(F.col("title")))
    s2 = token_set_ratio(concept_tokens(F.col("n")), concept_tokens(F.col("dx")))
    fuz = both.select("n", F.concat(F.lit("fuzzy"), F.col("score").cast("string")).alias("match_strategy"), F.col("u_id").alias("matched_uid"), F.when(s2 >= s1, F.col("dx")).otherwise(F.col("title")).alias("matched_dx"))
    found = gold.where(matchable).join(sub.unionByName(fuz), "n", "left")
    out = ["qid", "covered", "match_strategy", "matched_uid", "matched_dx", "gold_text", "body_system"]
    nothing = F.lit(None).cast("string")
    none = gold.where(~F.coalesce(matchable, F.lit(False))).withColumns({"covered": F.lit(False), "match_strategy": F.lit("non-matchable-gold"), "matched_uid": nothing, "matched_dx": nothing})
    return found.withColumn("covered", F.col("match_strategy").isNotNull()).select(*out).unionByName(none.select(*out))


def coverage_summary(cov: DataFrame) -> DataFrame:
    """Questions of each match strategy, and their percent of all."""
    counts = cov.groupBy(F.coalesce("match_strategy", F.lit("no-match")).alias("match_strategy")).agg(F.count("*").alias("n"))
    return counts.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def coverage_by_system(cov: DataFrame) -> DataFrame:
    """Total and covered questions of each body system."""
    return cov.groupBy("body_system").agg(F.count("*").alias("total"), F.count_if(F.col("covered")).alias("covered")).withColumn("percent", F.round(100.0 * F.col("covered") / F.col("total"), 6))


def accuracy_by_coverage(latest: DataFrame, cov: DataFrame) -> DataFrame:
    """Accuracy with its Wilson interval of each condition over all, covered and uncovered questions; no entry is uncovered."""
    joined = latest.join(cov.select("qid", "covered"), "qid", "left").withColumn("covered", F.coalesce("covered", F.lit(False)))
    both = joined.withColumn("subset", F.explode(F.array(F.lit("all"), F.when(F.col("covered"), "covered").otherwise("uncovered"))))
    counts = both.groupBy("condition", "subset").agg(F.sum(F.col("ok").cast("long")).alias("k"), F.count("*").alias("n"))
    p, low, high = wilson(F.col("k"), F.col("n"))
    return counts.select("condition", "subset", "k", "n", F.round(p, 6).alias("accuracy"), F.round(low, 6).alias("ci_low"), F.round(high, 6).alias("ci_high"))


def mcnemar_covered(latest: DataFrame, cov: DataFrame, baseline: str = BASELINE) -> DataFrame:
    """Every condition against the baseline over the covered questions only."""
    return mcnemar_pairwise(latest.join(cov.where("covered").select("qid"), "qid", "left_semi"), baseline)


