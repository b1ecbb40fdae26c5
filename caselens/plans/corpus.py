"""Queries over the case corpus and the question table: ETL, matching, coverage, sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselens.functions.text import STOP_WORDS, concept_tokens, is_fuzzy_match, is_substring, normalise, token_set_ratio
from caselens.operators import audit, corpus, coverage
from caselens.operators.prompts import fan_out
from caselens.operators.records import first_per_key, running_index, seeded_sample
from caselens.session import table

from .results import CHI2, LATEST, P_RAW, SP, WILSON, holm_sql, strip_sql


def norm_sql(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '[^\p{{L}}\p{{N}}_{SP}]', ' ', 'g'), '[{SP}]+', ' ', 'g'))"


STOP = "[" + ",".join(f"'{w}'" for w in STOP_WORDS) + "]"


def tokens_sql(x: str) -> str:
    return f"list_distinct(list_filter(string_split({norm_sql(x)}, ' '), lambda w: length(w) >= 3 AND NOT list_contains({STOP}, w)))"


def ratio_sql(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 THEN 0 ELSE (100 * len(list_intersect({a}, {b}))) // greatest(least(len({a}), len({b})), 1) END"


def _cases(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "medpix_cases")


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "medxpertqa_mm_2000")


CASE_FIELDS = ["title", "case_diagnosis", "differential_diagnosis", "modality", "plane", "location", "age", "sex", "history", "exam", "findings", "disease_discussion"]


def _first_cases(spark: SparkSession, d: str) -> DataFrame:
    return first_per_key(_cases(spark, d).select("u_id", "image_idx", "image_path", *CASE_FIELDS), ["u_id"], ["image_idx", "image_path"])


FIRST = "first_case AS (SELECT * FROM medpix_cases QUALIFY row_number() OVER (PARTITION BY u_id ORDER BY image_idx NULLS LAST, image_path NULLS LAST) = 1)"


def case_image_index(spark: SparkSession, d: str) -> DataFrame:
    """Images numbered within their case before those without a path go, so numbers may have gaps."""
    rows = _cases(spark, d).select("u_id", "image_idx", "image_path").distinct()
    numbered = running_index(rows, "u_id", ["image_idx", "image_path"], "new_idx").where("image_path is not null")
    return numbered.select("u_id", F.col("new_idx").cast("int").alias("new_idx"), "image_path", corpus.image_file(F.col("u_id"), F.col("new_idx")).alias("file_name"))


def case_counts(spark: SparkSession, d: str) -> DataFrame:
    """Images of each case beside the number the table states."""
    rows = _cases(spark, d).select("u_id", "image_idx", "image_path", "uid_n_images").distinct()
    return rows.groupBy("u_id").agg(F.count("*").alias("n_images"), F.max("uid_n_images").alias("stated"))


def first_per_case(spark: SparkSession, d: str) -> DataFrame:
    return _first_cases(spark, d).select("u_id", "title", "case_diagnosis")


def case_text(spark: SparkSession, d: str) -> DataFrame:
    return _first_cases(spark, d).select(F.col("u_id").alias("pdf_path"), F.lit(0).alias("page_number"), corpus.case_text().alias("text"))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """The last page of each case's extracted text; a whole text is moved once a case."""
    pages = table(spark, d, "medpix_case_text")
    return pages.groupBy(F.col("pdf_path").alias("u_id")).agg(F.max(F.struct("page_number", "text")).alias("m")).select("u_id", "m.text")


TEXTS = "texts AS (SELECT pdf_path AS u_id, text FROM medpix_case_text QUALIFY row_number() OVER (PARTITION BY pdf_path ORDER BY page_number DESC NULLS LAST, text DESC NULLS LAST) = 1)"
IMAGES = "images AS (SELECT u_id, list(image_path ORDER BY image_idx, image_path) AS paths FROM (SELECT DISTINCT u_id, image_idx, image_path FROM medpix_cases WHERE image_path IS NOT NULL) GROUP BY u_id)"
NOT_BLANK = rf"regexp_replace(coalesce(text, ''), '[{SP}]+', '', 'g') <> ''"


def documents_with_attachments(spark: SparkSession, d: str) -> DataFrame:
    docs = corpus.documents(_texts(spark, d), _cases(spark, d))
    return docs.select("id", "text", F.col("metadata.n_images").alias("n_images"), F.array_join(F.transform("modalities", lambda m: m["value"]), "|").alias("images"))


def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    """Rows, cases, images; texts, blank texts and the median length of the others."""
    cases, texts = _cases(spark, d), table(spark, d, "medpix_case_text")
    a = cases.agg(F.count("*").alias("n_rows"), F.count_distinct("u_id").alias("n_cases"), F.count_distinct("image_path").alias("n_images"))
    blank = corpus.is_blank(F.col("text"))
    b = texts.agg(F.count("*").alias("n_texts"), F.count_if(blank).alias("n_blank"), F.median(F.when(~blank, F.length("text"))).cast("int").alias("median_chars"))
    return a.join(b)


def question_projection(spark: SparkSession, d: str) -> DataFrame:
    """Distinct questions with defaults for missing strings, image paths by base name, and how many have no path."""
    q = first_per_key(_questions(spark, d).select("id", "question", "label", "medical_task", "images", "image_paths"), ["id"], ["question", "label", "medical_task"])
    none = F.array().cast("array<string>")
    images = F.coalesce("images", none)
    paths = F.transform(images, lambda x: F.concat(F.lit("images/"), F.element_at(F.split(x, "/"), -1)))
    known = F.coalesce("image_paths", none)
    return q.select("id", F.coalesce("question", F.lit("")).alias("question"), F.coalesce("label", F.lit("")).alias("label"), F.coalesce("medical_task", F.lit("")).alias("medical_task"), F.array_join(paths, "|").alias("paths"), F.greatest(F.size(images) - F.size(known), F.lit(0)).alias("n_unresolved"))


def conditions_fanout(spark: SparkSession, d: str) -> DataFrame:
    q = fan_out(_questions(spark, d).select("id").distinct())
    return q.groupBy("condition").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def sampled_questions(spark: SparkSession, d: str) -> DataFrame:
    """A seeded sample of 200 distinct questions in random order."""
    return seeded_sample(_questions(spark, d).select("id").distinct(), "id", 200)


def normalised_text(spark: SparkSession, d: str) -> DataFrame:
    return _cases(spark, d).select("u_id", "title").distinct().select("u_id", normalise(F.col("title")).alias("title"))


def token_set_score(spark: SparkSession, d: str) -> DataFrame:
    """Shared words of a case's title and diagnosis, and whether one holds the other."""
    t = _cases(spark, d).select("u_id", "title", "case_diagnosis").distinct()
    a, b = F.col("title"), F.col("case_diagnosis")
    return t.select("u_id", token_set_ratio(concept_tokens(a), concept_tokens(b)).alias("score"), is_substring(a, b).alias("held"), is_fuzzy_match(a, b).alias("fuzzy"))


def covered_questions(spark: SparkSession, d: str) -> DataFrame:
    cases = _first_cases(spark, d).select("u_id", "title", "case_diagnosis").withColumn("case_pos", F.col("u_id"))
    return coverage.coverage(_questions(spark, d), cases)


GOLD = """gold0 AS (SELECT id AS qid, map_extract(options, label)[1] AS gold_text, coalesce(body_system, '') AS body_system FROM medxpertqa_mm_2000),
 gold AS (SELECT * FROM gold0 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY gold_text NULLS LAST, body_system NULLS LAST) = 1)"""
COVERAGE = f"""{FIRST}, {GOLD},
 g AS (SELECT *, {norm_sql("gold_text")} AS n, {tokens_sql("gold_text")} AS gt FROM gold),
 c AS (SELECT u_id, coalesce(title, '') AS title, coalesce(case_diagnosis, '') AS dx, {norm_sql("title")} AS nt, {norm_sql("case_diagnosis")} AS nd, {tokens_sql("title")} AS tt, {tokens_sql("case_diagnosis")} AS td FROM first_case),
 matchable AS (SELECT * FROM g WHERE length(n) >= 4 AND len(gt) > 0),
 sub AS (SELECT qid, c.u_id, CASE WHEN dx <> '' THEN dx ELSE title END AS matched_dx FROM matchable JOIN c ON contains(nt, n) OR contains(nd, n) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY c.u_id) = 1),
 fz0 AS (SELECT qid, c.u_id, title, dx, {ratio_sql("gt", "tt")} AS s1, {ratio_sql("gt", "td")} AS s2 FROM matchable JOIN c ON true WHERE qid NOT IN (SELECT qid FROM sub)),
 fz AS (SELECT *, greatest(s1, s2) AS s FROM fz0 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY greatest(s1, s2) DESC, u_id) = 1),
 cov AS (SELECT g.qid, CASE WHEN m.qid IS NULL THEN false ELSE sub.qid IS NOT NULL OR coalesce(fz.s, 0) >= 90 END AS covered,
  CASE WHEN m.qid IS NULL THEN 'non-matchable-gold' WHEN sub.qid IS NOT NULL THEN 'substring' WHEN fz.s >= 90 THEN 'fuzzy' || fz.s END AS match_strategy,
  CASE WHEN sub.qid IS NOT NULL THEN sub.u_id WHEN fz.s >= 90 THEN fz.u_id END AS matched_uid,
  CASE WHEN sub.qid IS NOT NULL THEN sub.matched_dx WHEN fz.s >= 90 THEN CASE WHEN s2 >= s1 THEN fz.dx ELSE fz.title END END AS matched_dx, g.gold_text, g.body_system
  FROM g LEFT JOIN matchable m USING (qid) LEFT JOIN sub USING (qid) LEFT JOIN fz USING (qid))"""


def _case_text_sql() -> str:
    v = lambda c: strip_sql(f"coalesce({c}, '')")
    parts = [
        f"CASE WHEN {v('title')} <> '' THEN 'Diagnosis: ' || {v('title')} END",
        f"CASE WHEN {v('case_diagnosis')} <> '' AND {v('case_diagnosis')} <> {v('title')} THEN 'Case diagnosis: ' || {v('case_diagnosis')} END",
        f"CASE WHEN {v('differential_diagnosis')} <> '' AND {v('differential_diagnosis')} <> {v('case_diagnosis')} THEN 'Differential: ' || {v('differential_diagnosis')} END",
        *[f"CASE WHEN {v(c)} <> '' THEN '{h}: ' || {v(c)} END" for h, c in corpus.PLAIN_FIELDS],
        f"CASE WHEN {v('age')} <> '' OR {v('sex')} <> '' THEN 'Patient: ' || coalesce(nullif({v('age')}, ''), '?') || 'yo ' || coalesce(nullif({v('sex')}, ''), '?') END",
        *[f"CASE WHEN {v(c)} <> '' AND {v(c)} <> 'N/A' THEN '{h}: ' || {v(c)} END" for h, c in corpus.LONG_FIELDS],
    ]
    return "concat_ws(chr(10), " + ", ".join(parts) + ")"


QUERIES = {
    "case_image_index": (
        case_image_index,
        "WITH d AS (SELECT DISTINCT u_id, image_idx, image_path FROM medpix_cases), t AS (SELECT *, row_number() OVER (PARTITION BY u_id ORDER BY image_idx NULLS FIRST, image_path NULLS FIRST) - 1 AS i FROM d) SELECT u_id, i::INT AS new_idx, image_path, u_id || '_' || lpad(i::VARCHAR, 2, '0') || '.png' AS file_name FROM t WHERE image_path IS NOT NULL",
    ),
    "case_counts": (
        case_counts,
        "SELECT u_id, count(*) AS n_images, max(uid_n_images) AS stated FROM (SELECT DISTINCT u_id, image_idx, image_path, uid_n_images FROM medpix_cases) GROUP BY u_id",
    ),
    "first_per_case": (first_per_case, f"WITH {FIRST} SELECT u_id, title, case_diagnosis FROM first_case"),
    "case_text": (case_text, f"WITH {FIRST} SELECT u_id AS pdf_path, 0 AS page_number, {_case_text_sql()} AS text FROM first_case"),
    "documents_with_attachments": (
        documents_with_attachments,
        f"WITH {TEXTS}, {IMAGES} SELECT u_id AS id, text, coalesce(len(paths), 0)::INT AS n_images, coalesce(array_to_string(paths, '|'), '') AS images FROM texts LEFT JOIN images USING (u_id) WHERE {NOT_BLANK}",
    ),
    "corpus_stats": (
        corpus_stats,
        f"SELECT (SELECT count(*) FROM medpix_cases) AS n_rows, (SELECT count(DISTINCT u_id) FROM medpix_cases) AS n_cases, (SELECT count(DISTINCT image_path) FROM medpix_cases) AS n_images, (SELECT count(*) FROM medpix_case_text) AS n_texts, (SELECT count(*) FROM medpix_case_text WHERE NOT ({NOT_BLANK})) AS n_blank, (SELECT trunc(median(length(text)))::INT FROM medpix_case_text WHERE {NOT_BLANK}) AS median_chars",
    ),
    "question_projection": (
        question_projection,
        """WITH q AS (SELECT * FROM medxpertqa_mm_2000 QUALIFY row_number() OVER (PARTITION BY id ORDER BY question NULLS LAST, label NULLS LAST, medical_task NULLS LAST) = 1)
 SELECT id, coalesce(question, '') AS question, coalesce(label, '') AS label, coalesce(medical_task, '') AS medical_task, coalesce(array_to_string(list_transform(images, lambda x: 'images/' || string_split(x, '/')[-1]), '|'), '') AS paths, greatest(coalesce(len(images), 0) - coalesce(len(image_paths), 0), 0)::INT AS n_unresolved FROM q""",
    ),
    "conditions_fanout": (
        conditions_fanout,
        "SELECT condition, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM (SELECT DISTINCT id FROM medxpertqa_mm_2000) CROSS JOIN (VALUES ('no-rag'), ('use_vision-off'), ('use_vision-on')) v(condition) GROUP BY condition",
    ),
    "sampled_questions": (
        sampled_questions,
        "SELECT id, row_number() OVER (ORDER BY md5('42:' || id), id)::INT AS rank FROM (SELECT DISTINCT id FROM medxpertqa_mm_2000) QUALIFY rank <= 200",
    ),
    "normalised_text": (normalised_text, f"SELECT u_id, {norm_sql('title')} AS title FROM (SELECT DISTINCT u_id, title FROM medpix_cases)"),
    "token_set_score": (
        token_set_score,
        f"""WITH t AS (SELECT u_id, {norm_sql("title")} AS a, {norm_sql("case_diagnosis")} AS b, {tokens_sql("title")} AS ta, {tokens_sql("case_diagnosis")} AS tb FROM (SELECT DISTINCT u_id, title, case_diagnosis FROM medpix_cases))
 SELECT u_id, ({ratio_sql("ta", "tb")})::INT AS score, a <> '' AND b <> '' AND contains(b, a) AS held, a <> '' AND b <> '' AND ({ratio_sql("ta", "tb")}) >= 90 AS fuzzy FROM t""",
    ),
    "coverage": (covered_questions, f"WITH {COVERAGE} SELECT qid, covered, match_strategy, matched_uid, matched_dx, gold_text, body_system FROM cov"),
    "coverage_summary": (
        lambda s, d: coverage.coverage_summary(covered_questions(s, d)),
        f"WITH {COVERAGE} SELECT coalesce(match_strategy, 'no-match') AS match_strategy, count(*) AS n, round(100.0 * count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS percent FROM cov GROUP BY 1",
    ),
    "coverage_by_system": (
        lambda s, d: coverage.coverage_by_system(covered_questions(s, d)),
        f"WITH {COVERAGE} SELECT body_system, count(*) AS total, count(*) FILTER (covered) AS covered, round(100.0 * (count(*) FILTER (covered))::DOUBLE / count(*), 6) AS percent FROM cov GROUP BY 1",
    ),
    "accuracy_by_coverage": (
        lambda s, d: coverage.accuracy_by_coverage(audit.latest_records(table(s, d, "results")), covered_questions(s, d)),
        f"WITH {COVERAGE}, {LATEST}, j AS (SELECT condition, ok, coalesce(covered, false) AS covered FROM latest LEFT JOIN cov USING (qid)), t AS (SELECT condition, 'all' AS subset, sum(ok::INT)::BIGINT AS k, count(*) AS n FROM j GROUP BY 1 UNION ALL SELECT condition, CASE WHEN covered THEN 'covered' ELSE 'uncovered' END, sum(ok::INT)::BIGINT, count(*) FROM j GROUP BY 1, 2) SELECT condition, subset, k, n, {WILSON} FROM t",
    ),
    "mcnemar_covered": (
        lambda s, d: coverage.mcnemar_covered(audit.latest_records(table(s, d, "results")), covered_questions(s, d)),
        f"""WITH {COVERAGE}, {LATEST}, lc AS (SELECT * FROM latest WHERE qid IN (SELECT qid FROM cov WHERE covered)), acc AS (SELECT condition, avg(ok::INT) AS a FROM lc GROUP BY condition),
 counts AS (SELECT y.condition, sum((x.ok AND NOT y.ok)::INT)::BIGINT AS b, sum((NOT x.ok AND y.ok)::INT)::BIGINT AS c FROM lc x JOIN lc y ON x.qid = y.qid AND x.condition = 'no-rag' AND y.condition <> 'no-rag' GROUP BY 1),
 chi AS (SELECT *, {CHI2} AS chi2 FROM counts), tested AS (SELECT *, {P_RAW} AS p_raw FROM chi), {holm_sql("tested", "condition")}
 SELECT condition, b, c, round(chi2, 6) AS chi2, round(p_raw, 6) AS p_raw, round(p_holm, 6) AS p_holm, round((acc.a - (SELECT a FROM acc WHERE condition = 'no-rag')) * 100, 6) AS delta_pp, p_holm < 0.05 AS significant FROM adjusted JOIN acc USING (condition)""",
    ),
}
