"""Problem 2 over the docket tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators import orphans as o
from paperloom.session import materialize, table


def _file_link(docket, name):
    return F.concat(F.lit("file:"), docket.cast("string"), F.lit("/"), name)


def _input_link(docket):
    return F.concat(F.lit("input:"), docket.cast("string"))


def docket_references(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The references of the three docket tables to dockets, and when dockets are held."""
    inputs, decisions, manifest = (table(spark, d, t) for t in ("docket_review_input", "review_decisions", "export_manifest"))
    refs = (
        o.references(inputs, "docket_review_input", "input_id", o.docket_number(F.col("docket_id")), F.col("submitted_at"))
        .unionByName(o.references(decisions, "review_decisions", "decision_id", o.docket_number(F.col("docket_id")), F.try_to_timestamp("updated_at_utc")))
        .unionByName(o.references(manifest, "export_manifest", "manifest_id", o.docket_number(F.col("docket_id")), F.col("exported_at")))
    )
    held = table(spark, d, "sentencing_year_map").select(F.col("docket_id").cast("long").alias("key"), "loaded_at", "withdrawn_at")
    return materialize(refs, "orphan-refs"), held


def docket_links(spark: SparkSession, d: str, refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph below the dockets, as links provided and used: an input needs the exported files it selects, a decision
    the input of its docket."""
    inputs, manifest = table(spark, d, "docket_review_input"), table(spark, d, "export_manifest")
    files = manifest.select(F.lit("export_manifest").alias("table_name"), F.col("manifest_id").alias("row_id"), _file_link(o.docket_number(F.col("docket_id")), F.col("source_file_name")).alias("link"))
    given = refs.where("table_name = 'docket_review_input'").select("table_name", "row_id", _input_link(F.col("key")).alias("link"))
    selected = inputs.select(F.lit("docket_review_input").alias("table_name"), F.col("input_id").alias("row_id"), o.docket_number(F.col("docket_id")).alias("docket"), F.explode("selected_documents").alias("document"))
    wanted = selected.select("table_name", "row_id", _file_link(F.col("docket"), F.col("document.source_file_name")).alias("link"))
    judged = refs.where("table_name = 'review_decisions'").select("table_name", "row_id", _input_link(F.col("key")).alias("link"))
    return files.unionByName(given), wanted.unionByName(judged)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The frontier from which the cascade starts; what inherits from it is in ``p2_by_month``."""
    return o.direct_orphans(*docket_references(spark, d)).select("table_name", "row_id", "reason")


def p2_by_month(spark: SparkSession, d: str) -> DataFrame:
    refs, held = docket_references(spark, d)
    orphans = o.cascade(o.direct_orphans(refs, held), *docket_links(spark, d, refs), refs)
    return o.orphans_by_period(orphans).select("table_name", F.date_format("period", "yyyy-MM").alias("month"), "inherited", "reason", "n_rows")


def p2_unprovided(spark: SparkSession, d: str) -> DataFrame:
    """Selected files that no manifest row has and decisions on dockets without an input, per table and month."""
    refs, _ = docket_references(spark, d)
    found = o.unprovided(*docket_links(spark, d, refs), refs)
    return found.groupBy("table_name", F.date_format("at", "yyyy-MM").alias("month")).agg(F.count_distinct("row_id").alias("n_rows"), F.count("*").alias("n_links"))


QUERIES = {f.__name__: f for f in (p2_found, p2_by_month, p2_unprovided)}

_NUMBER = "CASE WHEN regexp_full_match(regexp_replace({0}, '^\\s+|\\s+$', '', 'g'), '[0-9]{{1,18}}') THEN CAST(regexp_replace({0}, '^\\s+|\\s+$', '', 'g') AS BIGINT) END"
_N = _NUMBER.format("docket_id")
_DIRECT = f"""
WITH refs AS (
  SELECT DISTINCT 'docket_review_input' AS table_name, input_id AS row_id, {_N} AS k, submitted_at AS ts FROM docket_review_input
  UNION ALL SELECT DISTINCT 'review_decisions', decision_id, {_N}, CAST(CAST(updated_at_utc AS TIMESTAMPTZ) AT TIME ZONE 'UTC' AS TIMESTAMP) FROM review_decisions
  UNION ALL SELECT DISTINCT 'export_manifest', manifest_id, {_N}, exported_at FROM export_manifest
), judged AS (
  SELECT r.table_name, r.row_id, r.ts, r.k,
    CASE WHEN count(m.docket_id) = 0 THEN 'missing'
         WHEN count(*) FILTER (WHERE m.loaded_at <= r.ts AND (m.withdrawn_at IS NULL OR r.ts < m.withdrawn_at)) > 0 THEN NULL
         WHEN count(*) FILTER (WHERE m.loaded_at <= r.ts) > 0 THEN 'deleted' ELSE 'late' END AS reason
  FROM refs r LEFT JOIN sentencing_year_map m ON m.docket_id = r.k
  WHERE r.k IS NOT NULL GROUP BY ALL
)"""
ORACLES = {
    "p2_found": f"{_DIRECT} SELECT table_name, row_id, reason FROM judged WHERE reason IS NOT NULL",
    "p2_by_month": f"""{_DIRECT}, files AS (
  SELECT j.k, e.source_file_name AS f FROM (SELECT DISTINCT manifest_id, source_file_name FROM export_manifest WHERE source_file_name IS NOT NULL) e
  JOIN judged j ON j.table_name = 'export_manifest' AND j.row_id = e.manifest_id GROUP BY ALL HAVING bool_and(j.reason IS NOT NULL)
), wanted AS (
  SELECT DISTINCT input_id, {_N} AS k, unnest(selected_documents).source_file_name AS f FROM docket_review_input
), inputs AS (
  SELECT j.*, j.reason IS NOT NULL OR j.row_id IN (SELECT w.input_id FROM wanted w JOIN files USING (k, f)) AS lost FROM judged j WHERE table_name = 'docket_review_input'
), gone AS (SELECT k FROM inputs GROUP BY k HAVING bool_and(lost)
), every AS (
  SELECT table_name, ts, reason, lost FROM inputs
  UNION ALL SELECT table_name, ts, reason, reason IS NOT NULL OR k IN (SELECT k FROM gone) FROM judged WHERE table_name = 'review_decisions'
  UNION ALL SELECT table_name, ts, reason, reason IS NOT NULL FROM judged WHERE table_name = 'export_manifest'
) SELECT table_name, strftime(ts, '%Y-%m') AS month, reason IS NULL AS inherited, reason, count(*) AS n_rows FROM every WHERE lost GROUP BY ALL""",
    "p2_unprovided": f"""WITH refs AS (
  SELECT DISTINCT 'docket_review_input' AS table_name, input_id AS row_id, {_N} AS k, submitted_at AS ts FROM docket_review_input
  UNION ALL SELECT DISTINCT 'review_decisions', decision_id, {_N}, CAST(CAST(updated_at_utc AS TIMESTAMPTZ) AT TIME ZONE 'UTC' AS TIMESTAMP) FROM review_decisions
), given AS (
  SELECT {_N} AS k, source_file_name AS f FROM export_manifest WHERE source_file_name IS NOT NULL AND {_N} IS NOT NULL UNION SELECT k, NULL FROM refs WHERE table_name = 'docket_review_input' AND k IS NOT NULL
), used AS (
  SELECT DISTINCT 'docket_review_input' AS table_name, input_id AS row_id, {_N} AS k, unnest(selected_documents).source_file_name AS f FROM docket_review_input
  UNION SELECT 'review_decisions', row_id, k, NULL FROM refs WHERE table_name = 'review_decisions'
), bad AS (
  SELECT * FROM used u WHERE k IS NOT NULL AND (f IS NOT NULL OR table_name = 'review_decisions') AND NOT EXISTS (SELECT 1 FROM given g WHERE g.k = u.k AND g.f IS NOT DISTINCT FROM u.f)
) SELECT b.table_name, strftime(r.ts, '%Y-%m') AS month, count(DISTINCT b.row_id) AS n_rows, count(*) AS n_links FROM bad b JOIN refs r USING (table_name, row_id) GROUP BY ALL""",
}
