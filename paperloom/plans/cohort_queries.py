"""Cohort, codes and selections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import text as t
from paperloom.operators import cohort as c
from paperloom.operators import selection as s
from paperloom.plans import frames
from paperloom.plans.frames import COHORT_SQL, FIRST_YEAR, LAST_YEAR
from paperloom.session import table


def _joined(column: str):
    return F.array_join(column, ",")


def _cohort(spark: SparkSession, d: str) -> DataFrame:
    return c.strict_cohort(frames.admissions(spark, d), frames.patients(spark, d), c.diagnoses_of(frames.diagnoses(spark, d)), frames.notes(spark, d), frames.ignored(spark, d), FIRST_YEAR, LAST_YEAR)


def cohort_strict(spark: SparkSession, d: str) -> DataFrame:
    return _cohort(spark, d).select("hadm_id", "subject_id", "note_id", F.length("input_text").alias("text_length"), _joined("output_icd_codes").alias("codes"), "real_discharge_year_min", "real_discharge_year_max")


def touched_anti(spark: SparkSession, d: str) -> DataFrame:
    dx = c.diagnoses_of(frames.diagnoses(spark, d))
    return frames.admissions(spark, d).join(c.touched_admissions(dx, frames.ignored(spark, d)), "hadm_id", "left_anti").select("hadm_id", "subject_id")


def codes_ordered(spark: SparkSession, d: str) -> DataFrame:
    return c.ordered_codes(c.diagnoses_of(frames.diagnoses(spark, d))).select("hadm_id", _joined("codes").alias("codes"), F.size("codes").alias("n_codes"))


def note_coverage(spark: SparkSession, d: str) -> DataFrame:
    chosen = c.eligible(frames.admissions(spark, d), frames.patients(spark, d), c.diagnoses_of(frames.diagnoses(spark, d)), frames.ignored(spark, d), FIRST_YEAR, LAST_YEAR)
    return c.note_coverage(chosen, frames.notes(spark, d))


def cohort_summary(spark: SparkSession, d: str) -> DataFrame:
    return c.cohort_summary(_cohort(spark, d))


def year_shift(spark: SparkSession, d: str) -> DataFrame:
    return c.discharge_years(frames.admissions(spark, d), frames.patients(spark, d)).select("hadm_id", "year_min", "year_max")


def code_norms(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit(" "), F.lower(F.substring("p_brand", 1, 7)), F.lit("."), F.substring("p_brand", 8, 3), F.lit(" "))
    return table(spark, d, "part").select("p_partkey", t.code_listed(raw).alias("listed"), t.code_stored(raw).alias("stored"), t.code_scored(raw).alias("scored"))


def code_lists(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit('["'), F.col("p_brand"), F.lit('", "'), F.col("p_type"), F.lit('", ""]'))).when(F.col("p_partkey") % 3 == 1, F.concat(F.col("p_brand"), F.lit("; "), F.col("p_type"), F.lit(" |,"))).otherwise(F.lit("  "))
    return table(spark, d, "part").select("p_partkey", _joined(t.code_list(raw)).alias("codes"))


def selectors_ordered(spark: SparkSession, d: str) -> DataFrame:
    """The first 500 cases by their keys."""
    return _cohort(spark, d).select("hadm_id", "subject_id", "note_id").orderBy("hadm_id", "subject_id", "note_id").limit(500)


def selectors_hash_sample(spark: SparkSession, d: str) -> DataFrame:
    return s.sample(frames.admissions(spark, d).select("hadm_id", "subject_id"), ["hadm_id"])


def request_order(spark: SparkSession, d: str) -> DataFrame:
    """Every customer asks for one order, in descending order of customers."""
    requests = table(spark, d, "customer").select((F.col("c_custkey") * 7).alias("hadm_id"), (-F.col("c_custkey")).alias("ord"))
    return s.in_requested_order(frames.admissions(spark, d), requests, ["hadm_id"]).select("ord", "hadm_id", "subject_id")


def missing_requests(spark: SparkSession, d: str) -> DataFrame:
    requests = table(spark, d, "customer").select((F.col("c_custkey") * 7).alias("hadm_id"), (-F.col("c_custkey")).alias("ord"))
    return s.missing_requests(frames.admissions(spark, d), requests, ["hadm_id"])


def paging(spark: SparkSession, d: str) -> DataFrame:
    return s.page(table(spark, d, "part").select("p_partkey", "p_name"), [F.col("p_name"), F.col("p_partkey")], 40, 25)


def batches(spark: SparkSession, d: str) -> DataFrame:
    made = s.batches(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 32)
    return made.groupBy("batch").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))


QUERIES = {f.__name__: f for f in (cohort_strict, touched_anti, codes_ordered, note_coverage, cohort_summary, year_shift, code_norms, code_lists, selectors_ordered, selectors_hash_sample, request_order, missing_requests, paging, batches)}

_STRICT = f"WITH {COHORT_SQL}, strict AS (SELECT hadm_id, subject_id, 'note-' || doc_id AS note_id, coalesce(text, '') AS text, codes, n, year_min, year_max FROM chosen JOIN documents ON doc_id = hadm_id JOIN codes USING (hadm_id))"
_RAW = "' ' || lower(substr(p_brand, 1, 7)) || '.' || substr(p_brand, 8, 3) || ' '"
ORACLES = {
    "cohort_strict": f"{_STRICT} SELECT hadm_id, subject_id, note_id, length(text) AS text_length, codes, year_min AS real_discharge_year_min, year_max AS real_discharge_year_max FROM strict",
    "touched_anti": f"WITH {COHORT_SQL} SELECT hadm_id, subject_id FROM admissions WHERE hadm_id NOT IN (SELECT hadm_id FROM touched)",
    "codes_ordered": f"WITH {COHORT_SQL} SELECT hadm_id, codes, n AS n_codes FROM codes",
    "note_coverage": f"WITH {COHORT_SQL} SELECT count(*) AS admissions, count(doc_id) AS with_note, count(*) - count(doc_id) AS without_note, 0 AS several_notes FROM chosen LEFT JOIN documents ON doc_id = hadm_id",
    "cohort_summary": f"{_STRICT} SELECT count(*) AS n_rows, count(DISTINCT hadm_id) AS n_admissions, count(DISTINCT subject_id) AS n_subjects, CAST(sum(n) AS BIGINT) AS n_codes, count(*) FILTER (WHERE text = '') AS n_empty_texts FROM strict",
    "year_shift": f"WITH {COHORT_SQL} SELECT hadm_id, year_min, year_max FROM dated",
    "code_norms": f"SELECT p_partkey, upper(replace(trim({_RAW}), '.', '')) AS listed, upper(replace({_RAW}, '.', '')) AS stored, regexp_replace(upper({_RAW}), '[^A-Z0-9]', '', 'g') AS scored FROM part",
    "code_lists": "SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN '' ELSE regexp_replace(upper(p_brand), '[^A-Z0-9]', '', 'g') || ',' || regexp_replace(upper(p_type), '[^A-Z0-9]', '', 'g') END AS codes FROM part",
    "selectors_ordered": f"{_STRICT} SELECT hadm_id, subject_id, note_id FROM strict ORDER BY ALL LIMIT 500",
    "selectors_hash_sample": "SELECT o_orderkey AS hadm_id, o_custkey AS subject_id FROM orders ORDER BY sha256('42:' || o_orderkey), o_orderkey LIMIT 1000",
    "request_order": "SELECT -c_custkey AS ord, o_orderkey AS hadm_id, o_custkey AS subject_id FROM customer JOIN orders ON o_orderkey = c_custkey * 7",
    "missing_requests": "SELECT c_custkey * 7 AS hadm_id, -c_custkey AS ord FROM customer WHERE c_custkey * 7 NOT IN (SELECT o_orderkey FROM orders)",
    "paging": "SELECT p_partkey, p_name FROM part ORDER BY p_name, p_partkey LIMIT 25 OFFSET 40",
    "batches": "SELECT (r - 1) // 32 AS batch, count(*) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS r FROM orders) GROUP BY 1",
}
