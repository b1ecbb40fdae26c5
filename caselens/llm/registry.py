"""The queries of the training-data problems, and their SQL where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselens.session import table

from .canonical import map_to_list
from .leaks import find_leaks
from .quality import quality_stats, train_quality
from .splitting import limits, oversized_items, split_oversized
from .targets import sample_to_targets
from .tokenizer import encode_documents

#: The vocabulary file of problem 5; never copied into the repository. The environment may name another.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
Query = Callable[[SparkSession, str], DataFrame]


def _sampler(spark: SparkSession, sf_dir: str):
    return sample_to_targets(table(spark, sf_dir, "medxpertqa_mm_2000"), table(spark, sf_dir, "sample_targets"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sampler(spark, sf_dir).gaps().select("plan_id", "category")


def p1_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sampler(spark, sf_dir).gaps()


def p1_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sampler(spark, sf_dir).sample().select("plan_id", F.col("item").alias("id"))


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sampler(spark, sf_dir).report()


_KEY = ["field_name", "item_key", "page_number"]


def _long_texts(spark: SparkSession, sf_dir: str) -> list[tuple[str, DataFrame]]:
    """The items of problem 2 by field: item_key, page_number, text."""
    text = table(spark, sf_dir, "medpix_case_text").select(F.col("pdf_path").alias("item_key"), "page_number", "text")
    talk = table(spark, sf_dir, "medpix_cases").select(F.col("u_id").alias("item_key"), F.lit(0).alias("page_number"), F.col("disease_discussion").alias("text"))
    return [("medpix_case_text.text", text), ("medpix_cases.disease_discussion", talk)]


def _pieces(spark: SparkSession, sf_dir: str, with_text: bool, distinct_first: bool) -> list[tuple[DataFrame, int]]:
    at, out = limits(table(spark, sf_dir, "split_limits")), []
    for field, items in _long_texts(spark, sf_dir):
        if field in at:
            items = items.withColumn("field_name", F.lit(field))
            pieces = split_oversized(items.distinct() if distinct_first else items, _KEY, "text", *at[field], with_text=with_text)
            out.append((pieces, at[field][0]))
    return out


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    # repeated rows are cut each and only their few columns made distinct: no text is shuffled
    a, *rest = [oversized_items(p, _KEY, n) for p, n in _pieces(spark, sf_dir, with_text=False, distinct_first=False)]
    for b in rest:
        a = a.unionByName(b)
    return a


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, *rest = [p for p, _ in _pieces(spark, sf_dir, with_text=True, distinct_first=True)]
    for b in rest:
        a = a.unionByName(b)
    return a


def p2_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every item whether its pieces keep the limit and share the overlap, and the hash of the text put together from them again."""
    at, out = limits(table(spark, sf_dir, "split_limits")), []
    for field, items in _long_texts(spark, sf_dir):
        if field in at:
            most, overlap = at[field]
            items = items.withColumn("field_name", F.lit(field)).distinct().withColumn("text_md5", F.md5("text"))
            keys = [*_KEY, "text_md5"]
            own = F.when(F.col("piece_no") == 1, F.col("piece_text")).otherwise(F.expr(f"substring(piece_text, {overlap + 1})"))
            pieces = split_oversized(items, keys, "text", most, overlap).withColumn("own", own)
            each = F.array_sort(F.collect_list(F.struct("piece_no", "piece_start", "piece_end", "own")))
            whole = pieces.groupBy(*keys, "n_chars").agg(F.max(F.col("piece_end") - F.col("piece_start")).alias("longest"), each.alias("p"))
            shared = F.forall(F.zip_with(F.slice("p", 2, F.size("p")), F.slice("p", 1, F.size("p")), lambda b, a: F.coalesce(a["piece_end"] - b["piece_start"] == overlap, F.lit(True))), lambda x: x)
            out.append(whole.select(*keys, "n_chars", (F.col("longest") <= most).alias("within_limit"), shared.alias("overlaps"), F.md5(F.array_join(F.transform("p", lambda x: x["own"]), "")).alias("joined_md5")))
    a, *rest = out
    for b in rest:
        a = a.unionByName(b)
    return a


def _typed_diagnoses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """field_name, rec_key, value of problem 4, one row a key."""
    cases = table(spark, sf_dir, "medpix_cases").select(F.col("u_id").alias("rec_key"), F.explode(F.create_map(F.lit("medpix_cases.title"), "title", F.lit("medpix_cases.case_diagnosis"), "case_diagnosis")).alias("field_name", "value"))
    options = table(spark, sf_dir, "medxpertqa_mm_2000").select("id", F.explode("options").alias("letter", "value"))
    options = options.select(F.lit("medxpertqa_mm_2000.options").alias("field_name"), F.concat("id", F.lit(":"), "letter").alias("rec_key"), "value")
    both = cases.select("field_name", "rec_key", "value").unionByName(options)
    return both.where("value is not null").groupBy("field_name", "rec_key").agg(F.max("value").alias("value"))


def p4_mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return map_to_list(_typed_diagnoses(spark, sf_dir), table(spark, sf_dir, "diagnosis_list"), ["field_name", "rec_key"], "value")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_mapped(spark, sf_dir).drop("score")


def p4_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the operator maps values to that are the name of an entry as it stands."""
    names = table(spark, sf_dir, "diagnosis_list").select(F.col("dx_name").alias("value")).distinct()
    values = _typed_diagnoses(spark, sf_dir).join(F.broadcast(names), "value", "left_semi")
    return map_to_list(values, table(spark, sf_dir, "diagnosis_list"), ["field_name", "rec_key"], "value").drop("score")


def p4_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values that name no entry, with the number of records of each."""
    values = _typed_diagnoses(spark, sf_dir)
    none = map_to_list(values.groupBy("field_name", "value").agg(F.count("*").alias("n_records")).withColumn("v", F.col("value")), table(spark, sf_dir, "diagnosis_list"), ["field_name", "value", "n_records"], "v")
    return none.where("ref_id = 0").select("field_name", "value", "n_records")


def p5_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), os.environ.get("CASELENS_VOCABULARY", VOCABULARY))


def p6_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "heldout_items"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_leaks(spark, sf_dir).select("item_id", "doc_id")


def p7_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_stats(docs, model=train_quality(docs))


def p7_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_stats(table(spark, sf_dir, "documents")).select("doc_id", "n_chars", "n_words")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_stats(spark, sf_dir).where("p_junk >= 0.5").select("doc_id")


def queries() -> dict[str, Query]:
    found = [p1_found, p1_gaps, p1_sample, p1_report, p2_found, p2_pieces, p2_checks, p4_found, p4_unmatched, p4_names, p5_ids, p6_found, p6_leaks, p7_found, p7_stats, p7_counts]
    return {f.__name__: f for f in found}


P1_SQL = r"""WITH q AS (SELECT DISTINCT id, f, lower(regexp_replace(v, '[^\p{L}]', '', 'g')) AS label FROM (
  SELECT id, unnest(['body_system', 'medical_task', 'question_type']) AS f, unnest([body_system, medical_task, question_type]) AS v FROM medxpertqa_mm_2000 WHERE id IS NOT NULL)),
 c AS (SELECT f, label, count(*) AS k FROM q GROUP BY f, label), n AS (SELECT count(DISTINCT id) AS n FROM medxpertqa_mm_2000)
SELECT plan_id, category{} FROM sample_targets t LEFT JOIN c ON c.f = t.field_name AND c.label = lower(regexp_replace(t.category, '[^\p{L}]', '', 'g')), n
WHERE coalesce(k, 0) < greatest(min_rows, target_share * sample_fraction * n)"""
P1_GAPS = """, field_name, coalesce(k, 0) AS available, round(target_share * sample_fraction * n, 6) AS wanted,
  round(greatest(min_rows, target_share * sample_fraction * n) - coalesce(k, 0), 6) AS gap"""

P2_SQL = r"""WITH items AS (SELECT DISTINCT 'medpix_case_text.text' AS field_name, pdf_path AS item_key, page_number, text FROM medpix_case_text
  UNION SELECT DISTINCT 'medpix_cases.disease_discussion', u_id, 0, disease_discussion FROM medpix_cases),
 long AS (SELECT i.*, max_chars FROM items i JOIN split_limits USING (field_name) WHERE length(text) > max_chars)
SELECT DISTINCT field_name, item_key, page_number, 'oversized' AS kind FROM long
UNION SELECT DISTINCT field_name, item_key, page_number, 'unbroken' FROM long WHERE list_max(list_transform(regexp_split_to_array(text, '[ \t\n\r]'), lambda x: length(x))) > max_chars"""

P2_CHECKS = """SELECT field_name, item_key, page_number, md5(text) AS text_md5, length(text) AS n_chars, TRUE AS within_limit, TRUE AS overlaps, md5(text) AS joined_md5 FROM (
  SELECT DISTINCT 'medpix_case_text.text' AS field_name, pdf_path AS item_key, page_number, text FROM medpix_case_text
  UNION SELECT DISTINCT 'medpix_cases.disease_discussion', u_id, 0, disease_discussion FROM medpix_cases) JOIN split_limits USING (field_name) WHERE text IS NOT NULL"""
P4_NAMES = """WITH t AS (SELECT u_id AS rec_key, unnest(['medpix_cases.title', 'medpix_cases.case_diagnosis']) AS field_name, unnest([title, case_diagnosis]) AS value FROM medpix_cases
  UNION ALL SELECT id || ':' || e.key, 'medxpertqa_mm_2000.options', e.value FROM (SELECT id, unnest(map_entries(options)) AS e FROM medxpertqa_mm_2000)),
 v AS (SELECT field_name, rec_key, max(value) AS value FROM t WHERE value IS NOT NULL GROUP BY ALL)
SELECT field_name, rec_key, ref_id FROM v JOIN diagnosis_list ON value = dx_name"""
P7_COUNTS = r"""SELECT doc_id, coalesce(length(text), 0)::DOUBLE AS n_chars, len(regexp_extract_all(coalesce(text, ''), '[^\s\x0B\x1C-\x1F\x{85}\p{Z}]+'))::DOUBLE AS n_words FROM documents"""


def oracle_sql() -> dict[str, str]:
    """Where SQL can say it on whole tables; the other operators are tested against brute force and held-out cases."""
    return {"p1_found": P1_SQL.replace("{}", ""), "p1_gaps": P1_SQL.replace("{}", P1_GAPS), "p2_found": P2_SQL, "p2_checks": P2_CHECKS, "p4_names": P4_NAMES, "p7_counts": P7_COUNTS}
