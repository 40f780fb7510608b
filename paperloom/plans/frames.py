"""The workload's tables derived from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators.orphans import docket_number
from paperloom.operators.selection import latest
from paperloom.session import table

FIRST_YEAR, LAST_YEAR = 1997, 2001


def admissions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("hadm_id"), F.col("o_custkey").alias("subject_id"), F.col("o_orderdate").alias("dischtime"))


def patients(spark: SparkSession, d: str) -> DataFrame:
    start = 1995 + 3 * (F.col("c_nationkey") % 3)
    return table(spark, d, "customer").select(F.col("c_custkey").alias("subject_id"), (1996 + F.col("c_custkey") % 5).alias("anchor_year"), F.concat(start.cast("string"), F.lit(" - "), (start + 2).cast("string")).alias("anchor_year_group"))


def diagnoses(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select("p_partkey", "p_brand")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber").join(part, F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(F.col("l_orderkey").alias("hadm_id"), F.lit(0).cast("long").alias("subject_id"), F.col("l_linenumber").alias("seq_num"), F.col("p_brand").alias("icd_code"), F.lit(10).alias("icd_version"))


def ignored(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where(F.regexp_extract("p_brand", r"(\d+)", 1).cast("int") % 13 == 0).select(F.upper("p_brand").alias("code")).distinct()


def notes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("hadm_id"), F.concat(F.lit("note-"), F.col("doc_id").cast("string")).alias("note_id"), F.lit(1).alias("note_seq"), F.coalesce("text", F.lit("")).alias("text"))


def reviews(spark: SparkSession, d: str) -> DataFrame:
    """Review decisions once each, dockets as plain numbers in text."""
    rows = table(spark, d, "review_decisions").dropDuplicates(["decision_id"])
    return rows.withColumn("docket_id", docket_number(F.col("docket_id")).cast("string")).where("docket_id is not null")


def inputs(spark: SparkSession, d: str) -> DataFrame:
    """Review inputs once each, the latest delivery, dockets as plain numbers in text."""
    rows = latest(table(spark, d, "docket_review_input"), ["input_id"], [F.col("ingested_at").desc_nulls_last()])
    return rows.withColumn("docket_id", docket_number(F.col("docket_id")).cast("string"))


def artifacts(spark: SparkSession, d: str, version: int | None = None) -> DataFrame:
    """One artifact per docket and version (input number modulo 3), the first input of each."""
    rows = inputs(spark, d).where("docket_id is not null").withColumn("review_version", (F.col("input_id") % 3).cast("int"))
    one = latest(rows, ["docket_id", "review_version"], [F.col("input_id")])
    stamp = F.date_format("submitted_at", "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    out = one.select("docket_id", stamp.alias("generated_at_utc"), stamp.alias("updated_at_utc"), F.when(F.col("case_facts").isNull(), "insufficient_evidence").otherwise("ready_for_review").alias("queue_label"), F.when(F.col("input_id") % 5 == 0, "insufficient").when(F.col("input_id") % 5 == 1, " Supported ").otherwise("supported").alias("docket_support_status"), F.when(F.col("input_id") % 7 != 0, (F.col("input_id") % 40).cast("int")).alias("final_total_offense_level"), "review_version", "source_run_id", "input_id", "case_facts")
    return out if version is None else out.where(F.col("review_version") == version)


def final_table(spark: SparkSession, d: str) -> DataFrame:
    """Final rows of the artifacts with facts, not yet reviewed."""
    a = artifacts(spark, d).where("case_facts is not null")
    return a.select("docket_id", "generated_at_utc", "updated_at_utc", (F.col("input_id") % 40).cast("int").alias("ground_truth_offense_level"), F.lit(False).alias("approved"), F.lit(None).cast("string").alias("review_decision"), F.lit(None).cast("string").alias("reviewed_at_utc"), F.lit(None).cast("string").alias("approved_by"), F.concat(F.lit("input "), F.col("input_id").cast("string")).alias("input_case_facts_text"), "review_version", "source_run_id")


# --- the same in SQL

NUMBER = "CASE WHEN regexp_full_match(regexp_replace({0}, '^\\s+|\\s+$', '', 'g'), '[0-9]{{1,18}}') THEN CAST(CAST(regexp_replace({0}, '^\\s+|\\s+$', '', 'g') AS BIGINT) AS VARCHAR) END"
_N = NUMBER.format("docket_id")

COHORT_SQL = f"""
admissions AS (SELECT o_orderkey AS hadm_id, o_custkey AS subject_id, o_orderdate AS dischtime FROM orders),
patients AS (SELECT c_custkey AS subject_id, 1996 + c_custkey % 5 AS anchor_year, 1995 + 3 * (c_nationkey % 3) AS g FROM customer),
diagnoses AS (SELECT l_orderkey AS hadm_id, l_linenumber AS seq_num, p_brand AS icd_code, upper(replace(p_brand, '.', '')) AS code FROM lineitem JOIN part ON l_partkey = p_partkey),
ignored AS (SELECT DISTINCT upper(p_brand) AS code FROM part WHERE CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INT) % 13 = 0),
touched AS (SELECT DISTINCT hadm_id FROM diagnoses WHERE code IN (SELECT code FROM ignored)),
dated AS (SELECT a.*, g + year(dischtime) - anchor_year AS year_min, g + 2 + year(dischtime) - anchor_year AS year_max FROM admissions a JOIN patients USING (subject_id)),
chosen AS (SELECT * FROM dated WHERE year_min >= {FIRST_YEAR} AND year_max <= {LAST_YEAR} AND hadm_id IN (SELECT hadm_id FROM diagnoses) AND hadm_id NOT IN (SELECT hadm_id FROM touched)),
codes AS (SELECT hadm_id, string_agg(icd_code, ',' ORDER BY seq_num, icd_code) AS codes, count(*) AS n FROM diagnoses GROUP BY hadm_id)"""

REVIEW_SQL = f"""
reviews AS (SELECT * REPLACE ({_N} AS docket_id) FROM (SELECT DISTINCT * FROM review_decisions) WHERE {_N} IS NOT NULL),
latest_inputs AS (SELECT * REPLACE ({_N} AS docket_id) FROM docket_review_input QUALIFY row_number() OVER (PARTITION BY input_id ORDER BY ingested_at DESC) = 1),
artifacts AS (SELECT docket_id, strftime(submitted_at, '%Y-%m-%dT%H:%M:%S+00:00') AS generated_at_utc, CASE WHEN case_facts IS NULL THEN 'insufficient_evidence' ELSE 'ready_for_review' END AS queue_label, CASE input_id % 5 WHEN 0 THEN 'insufficient' WHEN 1 THEN ' Supported ' ELSE 'supported' END AS docket_support_status, CASE WHEN input_id % 7 <> 0 THEN CAST(input_id % 40 AS INT) END AS final_total_offense_level, CAST(input_id % 3 AS INT) AS review_version, source_run_id, input_id, case_facts
  FROM latest_inputs WHERE docket_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY docket_id, input_id % 3 ORDER BY input_id) = 1),
final AS (SELECT docket_id, generated_at_utc, generated_at_utc AS updated_at_utc, CAST(input_id % 40 AS INT) AS level, 'input ' || input_id AS facts, review_version, source_run_id FROM artifacts WHERE case_facts IS NOT NULL),
done AS (SELECT docket_id, coalesce(review_version, 0) AS review_version, review_decision, updated_at_utc AS reviewed_at_utc, reviewer_name AS approved_by FROM reviews WHERE lower(trim(coalesce(claim_status, ''))) = 'completed'
  QUALIFY row_number() OVER (PARTITION BY docket_id, coalesce(review_version, 0) ORDER BY updated_at_utc DESC NULLS LAST, review_decision ASC NULLS LAST, reviewer_name ASC NULLS LAST) = 1),
applied AS (SELECT f.*, coalesce(lower(d.review_decision) = 'approved', false) AS approved, d.review_decision, d.reviewed_at_utc, d.approved_by FROM final f LEFT JOIN done d USING (docket_id, review_version))"""
