"""Queries over the evaluation records: parsing, scoring, paired tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselens.functions.parsers import PARSERS
from caselens.functions.text import strip
from caselens.operators import audit, generation
from caselens.operators.records import last_per_key
from caselens.session import table
from caselens.streaming.running import accuracy_by_window

SP = r"\s\x0B\x1C-\x1F\x{85}\p{Z}"
LATEST = """latest AS (SELECT qid, condition, coalesce(correct_boxed, correct, false) AS ok, coalesce(body_system, '') AS body_system
  FROM results QUALIFY row_number() OVER (PARTITION BY qid, condition ORDER BY pos DESC) = 1)"""
T = "(1 / (1 + sqrt(chi2 / 2) / 2))"
ERFC = (
    f"({T} * exp(-(chi2 / 2) - 1.26551223 + {T} * (1.00002368 + {T} * (0.37409196 + {T} * (0.09678418 + {T} * (-0.18628806 + {T} * (0.27886807 + {T} * "
    f"(-1.13520398 + {T} * (1.48851587 + {T} * (-0.82215223 + {T} * 0.17087277))))))))))"
)
CHI2 = "CASE WHEN b + c = 0 THEN 0.0 ELSE (abs(b - c) - 1.0) * (abs(b - c) - 1.0) / (b + c) END"
P_RAW = f"CASE WHEN b + c = 0 THEN 1.0 ELSE {ERFC} END"
WILSON = """coalesce(round(k / nullif(n, 0)::DOUBLE, 6), 0) AS accuracy,
  coalesce(round(greatest(0, (k / n::DOUBLE + 1.96*1.96/(2*n)) / (1 + 1.96*1.96/n) - 1.96*sqrt(k/n::DOUBLE*(1-k/n::DOUBLE)/n + 1.96*1.96/(4.0*n*n)) / (1 + 1.96*1.96/n)), 6), 0) AS ci_low,
  coalesce(round(least(1, (k / n::DOUBLE + 1.96*1.96/(2*n)) / (1 + 1.96*1.96/n) + 1.96*sqrt(k/n::DOUBLE*(1-k/n::DOUBLE)/n + 1.96*1.96/(4.0*n*n)) / (1 + 1.96*1.96/n)), 6), 0) AS ci_high"""


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^[{SP}]+|[{SP}]+$', '', 'g')"


def holm_sql(rows: str, tie: str) -> str:
    """``rows`` has p_raw; adds p_holm."""
    return f"""ranked AS (SELECT *, row_number() OVER (ORDER BY p_raw, {tie}) AS rk, count(*) OVER () AS m FROM {rows}),
 adjusted AS (SELECT *, max(least(1.0, p_raw * (m - rk + 1))) OVER (ORDER BY rk ROWS UNBOUNDED PRECEDING) AS p_holm FROM ranked)"""


OFFICIAL = r"""CASE WHEN len({l}) > 0 THEN CASE WHEN len(string_split({x}, 'ANSWER:')) > 1 THEN {l}[1] ELSE {l}[-1] END END"""
LETTERS = r"""list_filter(regexp_split_to_array(replace(replace(replace(replace(string_split({x}, 'ANSWER:')[-1], 'I understand', ''), 'A through J', ''), 'A through E', ''), 'A through D', ''), '[^\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[A-J]'))"""


def official_sql(x: str) -> str:
    return OFFICIAL.format(x=x, l=LETTERS.format(x=x))


def _hit(x: str, pattern: str) -> str:
    return f"upper(nullif(regexp_extract({x}, '{pattern}', 1), ''))"


def boxed_sql(x: str) -> str:
    return f"coalesce(nullif(regexp_extract({x}, '\\\\boxed\\{{\\s*([A-J])\\s*\\}}', 1), ''), {official_sql(x)})"


#: The parsers' patterns again, as DuckDB writes them, so that the SQL stands on its own.
STRICT_SQL = [
    r"(?i)\bANSWER\s*(?:is|:|=)\s*[\(\[\{]?\s*([A-J])\b",
    r"(?i)(?:the\s+)?(?:correct|best|right|final)\s+answer\s*(?:is|:|=)?\s*[\(\[\{]?\s*([A-J])\b",
    r"(?i)(?:therefore|hence|thus|so)\s*,?\s*the\s+answer\s+is\s*[\(\[\{]?\s*([A-J])\b",
    r"(?i)[\(\[\{]\s*([A-J])\s*[\)\]\}]\s+is\s+(?:the\s+)?(?:correct|best|right)\b",
    r"(?i)\b([A-J])\s+is\s+(?:the\s+)?(?:correct|best|right)\s+answer\b",
    r"\b([A-J])\.\s+[^:\n]{2,120}:\s*CORRECT\b",
]
LENIENT_SQL = [
    r"(?i)(?:answer|correct answer|best answer|option|choice)\s*(?:is|:|=)?\s*(?:[\(\[\{])?\s*([A-J])\b",
    r"[\(\[\{]\s*([A-J])\s*[\)\]\}]",
    r"(?im)^\s*(?:Answer|A)\s*[:\-]\s*([A-J])\b",
    r"\b([A-J])\s*[)\.]",
    r"\b([A-J])\b",
]


#: A letter alone on a line, and an answer's heading.
LONE_SQL, PREFIX_SQL = r"^\(?\s*([A-J])\s*[\)\.,;:]?\s*$", r"^\s*(?:A|Answer|ANSWER)\s*[:\-]\s*"


def strict_sql(x: str) -> str:
    raw = strip_sql(x)
    lines = rf"list_filter(list_transform(regexp_split_to_array({raw}, '\r\n|[\n\x0B\f\r\x1C-\x1E\x{{85}}\x{{2028}}\x{{2029}}]'), lambda s: {strip_sql('s')}), lambda s: s <> '')"
    lone = LONE_SQL
    return "coalesce(" + ", ".join([*[_hit(raw, p) for p in STRICT_SQL], _hit(f"{lines}[-1]", lone), _hit(f"{lines}[1]", lone)]) + ")"


def lenient_sql(x: str) -> str:
    rest = f"regexp_replace({x}, '{PREFIX_SQL}', '')"
    return "coalesce(" + ", ".join(_hit(rest, p) for p in LENIENT_SQL) + ")"


PARSER_SQL = {"official": official_sql, "strict": strict_sql, "lenient": lenient_sql, "boxed": boxed_sql}


def _results(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "results")


def _latest(spark: SparkSession, d: str) -> DataFrame:
    return audit.latest_records(_results(spark, d))


def _parse(name: str):
    return lambda spark, d: _results(spark, d).select("pos", PARSERS[name](F.col("raw_output")).alias("letter"))


def last_record_wins(spark: SparkSession, d: str) -> DataFrame:
    return last_per_key(_results(spark, d).select("qid", "condition", "pos", "predicted", "correct"), ["qid", "condition"], "pos")


def rescored(spark: SparkSession, d: str) -> DataFrame:
    scored = generation.score_outputs(_results(spark, d).select("pos", "gold", "raw_output"))
    return scored.select("pos", F.length(strip(F.coalesce("raw_output", F.lit("")))).cast("long").alias("n_chars"), *[f"{x}_{p}" for p in PARSERS for x in ("predicted", "correct")], "predicted", "correct")


def report_lines(spark: SparkSession, d: str) -> DataFrame:
    return audit.report_lines(audit.wilson_by_condition(_latest(spark, d)))


def running_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return accuracy_by_window(_results(spark, d))


def source_ranks(spark: SparkSession, d: str) -> DataFrame:
    """The retrieved cases of each record, a missing rank replaced by the place."""
    each = _results(spark, d).select("pos", F.posexplode("sources").alias("i", "s"))
    return each.select("pos", F.coalesce("s.rank", F.col("i") + 1).cast("int").alias("rank"), F.col("s.u_id").alias("u_id"), F.round("s.similarity", 6).alias("similarity"), F.coalesce("s.n_attached_images", F.lit(0)).alias("n_attached_images"))


def retrieval_counts(spark: SparkSession, d: str) -> DataFrame:
    """How often each case was retrieved, by how many questions, and at which mean rank."""
    each = _results(spark, d).select("qid", F.explode("sources").alias("s"))
    return each.groupBy(F.col("s.u_id").alias("u_id")).agg(F.count("*").alias("n"), F.count_distinct("qid").alias("n_questions"), F.round(F.avg("s.rank"), 6).alias("mean_rank"))


QUERIES = {
    "last_record_wins": (
        last_record_wins,
        "SELECT qid, condition, pos, predicted, correct FROM results QUALIFY row_number() OVER (PARTITION BY qid, condition ORDER BY pos DESC) = 1",
    ),
    **{f"parse_{p}": (_parse(p), f"SELECT pos, {sql('raw_output')} AS letter FROM results") for p, sql in PARSER_SQL.items()},
    "rescored": (
        rescored,
        "WITH t AS (SELECT pos, gold, " + strip_sql("coalesce(raw_output, '')") + " AS x FROM results), p AS (SELECT pos, gold, length(x) AS n_chars, "
        + ", ".join(f"{sql('x')} AS predicted_{p}" for p, sql in PARSER_SQL.items())
        + " FROM t) SELECT pos, n_chars, " + ", ".join(f"predicted_{p}, predicted_{p} IS NOT DISTINCT FROM gold AS correct_{p}" for p in PARSER_SQL)
        + ", predicted_boxed AS predicted, predicted_boxed IS NOT DISTINCT FROM gold AS correct FROM p",
    ),
    "score_by_condition": (
        lambda s, d: audit.score_by_condition(_results(s, d)),
        "SELECT condition, count(*) AS total, sum(coalesce(correct_boxed, correct, false)::INT)::BIGINT AS correct, round(sum(coalesce(correct_boxed, correct, false)::INT) / count(*)::DOUBLE, 6) AS accuracy FROM results GROUP BY condition",
    ),
    "score_by_parser": (
        lambda s, d: audit.score_by_parser(_results(s, d)),
        " UNION ALL ".join(
            f"SELECT condition, '{p}' AS parser, count(*) AS total, sum(coalesce(correct_{p}, false)::INT)::BIGINT AS correct, count(*) FILTER (predicted_{p} IS NULL) AS null_pred, round(sum(coalesce(correct_{p}, false)::INT) / count(*)::DOUBLE, 6) AS accuracy FROM results GROUP BY condition"
            for p in PARSERS
        ),
    ),
    "score_by_condition_system": (
        lambda s, d: audit.score_by_condition_and_system(_results(s, d)),
        "SELECT condition || '::' || coalesce(body_system, '') AS key, sum(coalesce(correct_boxed, correct, false)::INT)::BIGINT AS correct, count(*) AS total FROM results GROUP BY 1",
    ),
    "wilson_by_condition": (
        lambda s, d: audit.wilson_by_condition(_latest(s, d)),
        f"WITH {LATEST}, t AS (SELECT condition, sum(ok::INT)::BIGINT AS k, count(*) AS n FROM latest GROUP BY condition) SELECT condition, k, n, {WILSON} FROM t",
    ),
    "report_lines": (
        report_lines,
        f"WITH {LATEST}, t AS (SELECT condition, sum(ok::INT)::BIGINT AS k, count(*) AS n FROM latest GROUP BY condition), w AS (SELECT condition, k, n, {WILSON} FROM t) SELECT condition, printf('%s %d/%d %.4f [%.4f, %.4f]', condition, k::BIGINT, n, accuracy::DOUBLE, ci_low::DOUBLE, ci_high::DOUBLE) AS line FROM w",
    ),
    "discordant_pairs": (
        lambda s, d: audit.discordant_pairs(_latest(s, d)),
        f"WITH {LATEST}, t AS (SELECT x.condition AS cond_a, y.condition AS cond_b, sum((x.ok AND NOT y.ok)::INT)::BIGINT AS b, sum((NOT x.ok AND y.ok)::INT)::BIGINT AS c FROM latest x JOIN latest y ON x.qid = y.qid AND x.condition < y.condition GROUP BY 1, 2) SELECT *, b + c AS total, c - b AS net FROM t",
    ),
    "mcnemar_pairwise": (
        lambda s, d: audit.mcnemar_pairwise(_latest(s, d)),
        f"""WITH {LATEST}, acc AS (SELECT condition, avg(ok::INT) AS a FROM latest GROUP BY condition),
 counts AS (SELECT y.condition, sum((x.ok AND NOT y.ok)::INT)::BIGINT AS b, sum((NOT x.ok AND y.ok)::INT)::BIGINT AS c FROM latest x JOIN latest y ON x.qid = y.qid AND x.condition = 'no-rag' AND y.condition <> 'no-rag' GROUP BY 1),
 chi AS (SELECT *, {CHI2} AS chi2 FROM counts), tested AS (SELECT *, {P_RAW} AS p_raw FROM chi), {holm_sql("tested", "condition")}
 SELECT condition, b, c, round(chi2, 6) AS chi2, round(p_raw, 6) AS p_raw, round(p_holm, 6) AS p_holm, round((acc.a - (SELECT a FROM acc WHERE condition = 'no-rag')) * 100, 6) AS delta_pp, p_holm < 0.05 AS significant FROM adjusted JOIN acc USING (condition)""",
    ),
    "mcnemar_by_stratum": (
        lambda s, d: audit.mcnemar_by_stratum(_latest(s, d)),
        f"""WITH {LATEST}, target AS (SELECT max(condition) AS t FROM latest WHERE condition <> 'no-rag'),
 counts AS (SELECT x.body_system, count(*) AS n, sum((x.ok AND NOT coalesce(y.ok, false))::INT)::BIGINT AS b, sum((NOT x.ok AND coalesce(y.ok, false))::INT)::BIGINT AS c
  FROM latest x LEFT JOIN (SELECT * FROM latest WHERE condition = (SELECT t FROM target)) y ON x.qid = y.qid WHERE x.condition = 'no-rag' AND x.body_system <> '' GROUP BY 1),
 chi AS (SELECT *, {CHI2} AS chi2 FROM counts), tested AS (SELECT *, {P_RAW} AS p_raw FROM chi), {holm_sql("tested", "body_system")}
 SELECT body_system, n, b, c, round(chi2, 6) AS chi2, round(p_raw, 6) AS p_raw, round(p_holm, 6) AS p_holm, p_holm < 0.05 AS significant FROM adjusted""",
    ),
    "running_accuracy": (
        running_accuracy,
        "SELECT date_trunc('day', finished_at) AS window_start, condition, count(*) AS total, sum(coalesce(correct_boxed, correct, false)::INT)::BIGINT AS correct FROM results WHERE finished_at IS NOT NULL GROUP BY 1, 2",
    ),
    "source_ranks": (
        source_ranks,
        "WITH t AS (SELECT pos, unnest(sources) AS s, generate_subscripts(sources, 1) AS i FROM results) SELECT pos, coalesce(s.rank, i)::INT AS rank, s.u_id, round(s.similarity, 6) AS similarity, coalesce(s.n_attached_images, 0) AS n_attached_images FROM t",
    ),
    "retrieval_counts": (
        retrieval_counts,
        "WITH t AS (SELECT qid, unnest(sources) AS s FROM results) SELECT s.u_id AS u_id, count(*) AS n, count(DISTINCT qid) AS n_questions, round(avg(s.rank), 6) AS mean_rank FROM t GROUP BY 1",
    ),
}
