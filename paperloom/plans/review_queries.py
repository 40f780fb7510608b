"""Review store, lookups and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import text as t
from paperloom.operators import lookups, review, selection, store
from paperloom.operators.orphans import docket_number
from paperloom.plans import frames
from paperloom.plans.frames import REVIEW_SQL
from paperloom.session import table

# Fixed value: the moment at which claims are judged.
NOW = "2020-01-01 00:00:00"
# Phrases that would give an answer away.
LEAKY = ["total offense level is", "base level of", "guideline range"]


def _now():
    return F.lit(NOW).cast("timestamp")


def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    rows = frames.reviews(spark, d)
    return selection.latest(rows, ["docket_id"], selection.newest_first("updated_at_utc", "review_version", "decision_id")).select("docket_id", "decision_id")


def upsert_all(spark: SparkSession, d: str) -> DataFrame:
    """Version 0 and 1 of the artifacts, changed by a later run over every third docket of version 1 and new rows of version 2."""
    a = frames.artifacts(spark, d).drop("case_facts")
    target = a.where("review_version < 2")
    source = a.where("review_version = 2 or (review_version = 1 and cast(docket_id as bigint) % 3 = 0)").withColumn("queue_label", F.lit("rerun"))
    return store.upsert(target, source).select("docket_id", "review_version", "queue_label", "input_id")


def upsert_preserve(spark: SparkSession, d: str) -> DataFrame:
    """Reviewed final rows met by a second run of the same artifacts: what reviewers set stays."""
    final = review.replay(frames.final_table(spark, d), frames.reviews(spark, d), 1)
    again = frames.final_table(spark, d).withColumns({"generated_at_utc": F.lit("2030-01-01T00:00:00+00:00"), "ground_truth_offense_level": F.col("ground_truth_offense_level") + 1})
    return store.upsert_preserving(final, again).select("docket_id", "review_version", "generated_at_utc", "ground_truth_offense_level", "approved", "review_decision", "approved_by")


def approval_update(spark: SparkSession, d: str) -> DataFrame:
    return store.update_approvals(frames.final_table(spark, d), review.completed(frames.reviews(spark, d))).select("docket_id", "review_version", "approved", "review_decision", "reviewed_at_utc", "approved_by")


def approved_final(spark: SparkSession, d: str) -> DataFrame:
    final = store.update_approvals(frames.final_table(spark, d), review.completed(frames.reviews(spark, d)))
    return review.approved_release(final, frames.reviews(spark, d))


def approved_missing(spark: SparkSession, d: str) -> DataFrame:
    final = store.update_approvals(frames.final_table(spark, d), review.completed(frames.reviews(spark, d)))
    return review.approved_without_row(final, frames.reviews(spark, d))


def queue_carry_forward(spark: SparkSession, d: str) -> DataFrame:
    """The whole queue of version 1, unsupported dockets too."""
    made = review.review_queue(frames.artifacts(spark, d), frames.reviews(spark, d), 1, supported_only=False)
    return made.select("docket_id", "queue_label", "input_id", "claim_status", "review_decision", "review_source_version", "review_carried_forward")


def queue_supported(spark: SparkSession, d: str) -> DataFrame:
    made = review.review_queue(frames.artifacts(spark, d), frames.reviews(spark, d), 2)
    return made.select("docket_id", "docket_support_status", "final_total_offense_level", "updated_at_utc", "reviewer_name", "claim_status", "claimed_at_utc", "review_notes", "review_source_version", "review_carried_forward")


def released(spark: SparkSession, d: str) -> DataFrame:
    """Claims of version 1 given up: by their own token on dockets with an even number, by a stranger's on the others."""
    rows = selection.latest(frames.reviews(spark, d), ["docket_id", "review_version"], selection.newest_first("updated_at_utc", "decision_id"))
    asked = rows.where("review_version = 1").select("docket_id", F.when(F.col("docket_id").cast("long") % 2 == 0, F.concat(F.lit(" "), "claim_token")).otherwise("stranger").alias("claim_token"))
    made = review.release(rows, asked, 1, F.lit("2020-06-01 00:00:00").cast("timestamp"))
    return made.select("decision_id", "reviewer_name", "claim_status", "claim_token", "claimed_at_utc", "updated_at_utc", "review_decision", "review_notes", "verification_json")


def facts_merged(spark: SparkSession, d: str) -> DataFrame:
    """Artifacts with a field of their own, facts replaced by those of the input."""
    a = frames.artifacts(spark, d)
    old = F.to_json(F.struct(F.col("docket_id"), F.struct(F.col("queue_label").alias("label"), F.array("review_version").alias("list")).alias("nested"), F.array(F.struct(F.lit("old").alias("fact"))).alias("case_facts"), F.col("source_run_id").alias("kept")))
    merged = review.merge_facts(old, review.facts_of(F.col("case_facts")))
    get = lambda p: F.get_json_object(merged, p)
    return a.select("input_id", get("$.docket_id").alias("docket"), get("$.nested.label").alias("label"), get("$.nested.list[0]").alias("version"), get("$.kept").alias("kept"), F.size(F.from_json(get("$.case_facts"), "array<string>")).alias("n_facts"), get("$.case_facts[0].fact").alias("fact"))


def claim_eligible(spark: SparkSession, d: str) -> DataFrame:
    rows = selection.latest(frames.reviews(spark, d), ["docket_id"], selection.newest_first("updated_at_utc", "review_version", "decision_id"))
    return review.claimable(rows, "none", _now()).select("docket_id", "claim_status")


def copy_approvals(spark: SparkSession, d: str) -> DataFrame:
    made = review.copy_approvals(frames.reviews(spark, d), frames.artifacts(spark, d), 1, 2, _now())
    return made.select("docket_id", "review_version", "review_decision", "updated_at_utc", F.get_json_object("verification_json", "$.copied_from_version").alias("copied_from"))


def facts_parsed(spark: SparkSession, d: str) -> DataFrame:
    facts = review.facts_of(F.col("case_facts"))
    return frames.inputs(spark, d).select("input_id", F.size(facts).alias("n_facts"), facts[0]["support_strength"].alias("first_strength"))


def fact_clean(spark: SparkSession, d: str) -> DataFrame:
    cleaned = review.clean_facts(review.facts_of(F.col("case_facts")), LEAKY)
    return frames.inputs(spark, d).select("input_id", F.size(cleaned).alias("n"), F.md5(F.array_join(cleaned, "\n")).alias("digest"))


def json_extract(spark: SparkSession, d: str) -> DataFrame:
    """The object inside an answer that wraps it in fences or prose; a list or a broken object gives none."""
    k = F.col("event_id") % 4
    answer = F.when(k == 0, F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))).when(k == 1, F.concat(F.lit("The answer: "), F.col("props"), F.lit(" as asked."))).when(k == 2, F.concat(F.lit("["), F.col("props"), F.lit("]"))).otherwise(F.substring("props", 1, 4))
    return table(spark, d, "events").select("event_id", F.get_json_object(t.json_object(answer), "$.k").cast("int").alias("k"))


def sentencing_lookup(spark: SparkSession, d: str) -> DataFrame:
    years = table(spark, d, "sentencing_year_map").select(F.col("docket_id").cast("string").alias("docket_id"), "sentencing_year", "year_lookup_status")
    return lookups.with_year(frames.inputs(spark, d).select("input_id", "docket_id"), years).select("input_id", "sentencing_year", "year_status")


def _case_source(spark: SparkSession, d: str) -> DataFrame:
    rows = frames.inputs(spark, d).where("docket_id is not null")
    return rows.select("docket_id", F.year("submitted_at").alias("year"), F.concat(F.lit("doc-"), F.lpad(F.col("input_id").cast("string"), 9, "0")).alias("document_id"))


def case_year_enrich(spark: SparkSession, d: str) -> DataFrame:
    cases = frames.reviews(spark, d).select("decision_id", "docket_id")
    years = table(spark, d, "sentencing_year_map").select(F.col("docket_id").cast("string").alias("docket_id"), "sentencing_year")
    return lookups.case_year(cases, _case_source(spark, d), years).select("decision_id", "case_year", "document_id", "status")


def value_resolve(spark: SparkSession, d: str) -> DataFrame:
    cases = table(spark, d, "customer").select(F.col("c_custkey").alias("docket_id"), (F.col("c_custkey") % 6 + 1995).cast("int").alias("year"))
    values = table(spark, d, "orders").select(F.col("o_custkey").alias("docket_id"), F.year("o_orderdate").alias("year"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")).alias("value"))
    return lookups.resolve_value(cases, values).select("docket_id", "value", "status")


def overlay_accept(spark: SparkSession, d: str) -> DataFrame:
    left = table(spark, d, "orders").select(F.col("o_custkey").alias("docket_id"), "o_orderkey", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderstatus")).alias("flag"))
    right = table(spark, d, "customer").select(F.col("c_custkey").alias("docket_id"), F.when(F.col("c_custkey") % 3 == 0, F.lit("X")).alias("flag"), F.col("c_mktsegment").alias("reason"))
    return lookups.overlay(left, right, ["docket_id"], ["flag"], "acceptance_", [F.col("flag").asc_nulls_last()])


def manifest_status(spark: SparkSession, d: str) -> DataFrame:
    """Paths of the manifest exported anew: those with content exist, those with an error fail."""
    m = table(spark, d, "export_manifest").dropDuplicates(["manifest_id"])
    sources = m.select("source_pdf_path").where("source_pdf_path is not null").distinct()
    made = review.export_status(sources, selection.latest(m.where("content_length is not null and source_pdf_path is not null"), ["source_pdf_path"], [F.col("content_length").desc(), F.col("page_count").desc_nulls_last()]), m.where("error_type is not null"))
    return made.select("source_pdf_path", "status", "content_length")


def manifest_counts(spark: SparkSession, d: str) -> DataFrame:
    return lookups.status_counts(table(spark, d, "export_manifest").dropDuplicates(["manifest_id"]))


def pending_dockets(spark: SparkSession, d: str) -> DataFrame:
    dockets = table(spark, d, "sentencing_year_map").select(F.col("docket_id").cast("string").alias("docket_id")).distinct()
    return review.pending(dockets, frames.artifacts(spark, d), 1)


def path_dockets(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "export_manifest").dropDuplicates(["manifest_id"])
    return m.select("manifest_id", t.docket_of_path(F.col("source_pdf_path"), "/Volumes/sentencing").alias("docket"), t.file_document_id(F.element_at(F.split("output_json_path", "/"), -1)).alias("document"))


def case_texts(spark: SparkSession, d: str) -> DataFrame:
    rows = frames.inputs(spark, d).where("docket_id is not null").select("docket_id", F.lpad(F.col("input_id").cast("string"), 9, "0").alias("document_id"), F.col("source_run_id").alias("source_pdf_path"), F.lit(None).cast("string").alias("source_file_name"), F.col("case_summary").alias("text"))
    made = review.case_texts(rows, 3000)
    return made.select("docket_id", F.length("text").alias("n"), F.md5("text").alias("digest"))


QUERIES = {
    f.__name__: f
    for f in (latest_per_key, upsert_all, upsert_preserve, approval_update, approved_final, approved_missing, queue_carry_forward, queue_supported, released, facts_merged, claim_eligible, copy_approvals, facts_parsed, fact_clean, json_extract, sentencing_lookup, case_year_enrich, value_resolve, overlay_accept, manifest_status, manifest_counts, pending_dockets, path_dockets, case_texts)
}

_W = f"WITH {REVIEW_SQL}"
_MANIFEST = "m AS (SELECT DISTINCT ON (manifest_id) * FROM export_manifest)"
_APPROVED = "said AS (SELECT DISTINCT docket_id FROM reviews WHERE lower(trim(coalesce(review_decision, ''))) = 'approved'), released AS (SELECT docket_id, facts AS input, level AS output FROM applied WHERE docket_id IN (SELECT docket_id FROM said) QUALIFY row_number() OVER (PARTITION BY docket_id ORDER BY review_version DESC NULLS LAST, reviewed_at_utc DESC NULLS LAST, updated_at_utc DESC NULLS LAST, generated_at_utc DESC NULLS LAST, source_run_id DESC NULLS LAST) = 1)"
_OWN = "u AS (SELECT *, coalesce(review_version, 0) = {0} AS own FROM reviews WHERE coalesce(review_version, 0) = {0} OR lower(trim(coalesce(claim_status, ''))) = 'completed' QUALIFY row_number() OVER (PARTITION BY docket_id ORDER BY (coalesce(review_version, 0) = {0}) DESC, coalesce(review_version, 0) DESC, updated_at_utc DESC NULLS LAST, review_decision ASC NULLS LAST) = 1)"
_BODY = r"regexp_replace(regexp_replace(trim(case_facts, ' ' || chr(10) || chr(13) || chr(9)), '^```(?:json|JSON)?\s*', ''), '\s*```$', '')"
_ENDS = r"'^[\s\pZ]+|[\s\pZ]+$'"
_FACTS = f"j AS (SELECT input_id, CASE WHEN json_valid({_BODY}) THEN {_BODY} END AS b FROM latest_inputs), p AS (SELECT input_id, CASE WHEN b LIKE '[%' THEN CAST(b AS JSON) WHEN b LIKE '{{%' THEN json_extract(b, '$.case_facts') END AS facts FROM j)"
ORACLES = {
    "latest_per_key": f"{_W} SELECT docket_id, decision_id FROM reviews QUALIFY row_number() OVER (PARTITION BY docket_id ORDER BY updated_at_utc DESC NULLS LAST, review_version DESC NULLS LAST, decision_id DESC NULLS LAST) = 1",
    "upsert_all": f"{_W}, s AS (SELECT *, review_version = 2 OR (review_version = 1 AND CAST(docket_id AS BIGINT) % 3 = 0) AS again FROM artifacts) SELECT docket_id, review_version, CASE WHEN again THEN 'rerun' ELSE queue_label END AS queue_label, input_id FROM s",
    "upsert_preserve": f"{_W} SELECT docket_id, review_version, generated_at_utc, level + 1 AS ground_truth_offense_level, CASE WHEN review_version = 1 THEN approved ELSE false END AS approved, CASE WHEN review_version = 1 THEN review_decision END AS review_decision, CASE WHEN review_version = 1 THEN approved_by END AS approved_by FROM applied",
    "approval_update": f"{_W} SELECT docket_id, review_version, approved, review_decision, reviewed_at_utc, approved_by FROM applied",
    "approved_final": f"{_W}, {_APPROVED} SELECT * FROM released",
    "approved_missing": f"{_W}, {_APPROVED} SELECT docket_id FROM said WHERE docket_id NOT IN (SELECT docket_id FROM released)",
    "queue_carry_forward": f"""{_W}, {_OWN.format(1)}
 SELECT a.docket_id, a.queue_label, a.input_id, u.claim_status, u.review_decision, u.review_version AS review_source_version, coalesce(NOT u.own, false) AS review_carried_forward FROM artifacts a LEFT JOIN u ON u.docket_id = a.docket_id WHERE a.review_version = 1 AND final_total_offense_level IS NOT NULL""",
    "queue_supported": f"""{_W}, {_OWN.format(2)}
 SELECT a.docket_id, a.docket_support_status, a.final_total_offense_level, a.generated_at_utc AS updated_at_utc, u.reviewer_name, u.claim_status, u.claimed_at_utc, u.review_notes, u.review_version AS review_source_version, coalesce(NOT u.own, false) AS review_carried_forward FROM artifacts a LEFT JOIN u ON u.docket_id = a.docket_id WHERE a.review_version = 2 AND final_total_offense_level IS NOT NULL AND lower(trim(docket_support_status)) = 'supported'""",
    "released": f"""{_W}, r AS (SELECT * FROM reviews QUALIFY row_number() OVER (PARTITION BY docket_id, review_version ORDER BY updated_at_utc DESC NULLS LAST, decision_id DESC NULLS LAST) = 1),
 f AS (SELECT *, review_version = 1 AND (CAST(docket_id AS BIGINT) % 2 = 1 OR trim(coalesce(claim_token, '')) <> '') AND NOT (coalesce(claim_status, '') = 'claimed' AND CAST(docket_id AS BIGINT) % 2 = 1 AND coalesce(claim_token, '') <> 'stranger' AND claimed_at_utc IS NOT NULL AND CAST(claimed_at_utc AS TIMESTAMPTZ) >= TIMESTAMPTZ '2020-06-01 00:00:00+00' - INTERVAL 45 MINUTE) AS free FROM r)
 SELECT decision_id, CASE WHEN free THEN '' ELSE reviewer_name END AS reviewer_name, CASE WHEN free THEN 'available' ELSE claim_status END AS claim_status, CASE WHEN free THEN '' ELSE claim_token END AS claim_token, CASE WHEN free THEN '' ELSE claimed_at_utc END AS claimed_at_utc, CASE WHEN free THEN '2020-06-01T00:00:00+00:00' ELSE updated_at_utc END AS updated_at_utc, CASE WHEN free THEN '' ELSE review_decision END AS review_decision, CASE WHEN free THEN '' ELSE review_notes END AS review_notes, CASE WHEN free THEN '' ELSE verification_json END AS verification_json FROM f""",
    "facts_merged": f"""{_W}, {_FACTS} SELECT a.input_id, a.docket_id AS docket, a.queue_label AS label, CAST(a.review_version AS VARCHAR) AS version, a.source_run_id AS kept, CAST(coalesce(json_array_length(facts), 0) AS INT) AS n_facts, json_extract_string(facts, '$[0].fact') AS fact FROM artifacts a JOIN p USING (input_id)""",
    "claim_eligible": f"""{_W}, r AS (SELECT * FROM reviews QUALIFY row_number() OVER (PARTITION BY docket_id ORDER BY updated_at_utc DESC NULLS LAST, review_version DESC NULLS LAST, decision_id DESC NULLS LAST) = 1)
 SELECT docket_id, claim_status FROM r WHERE lower(trim(coalesce(claim_status, ''))) <> 'completed' AND (trim(coalesce(reviewer_name, '')) = '' OR lower(trim(coalesce(claim_status, ''))) <> 'claimed' OR claim_token = 'none' OR claimed_at_utc IS NULL OR CAST(claimed_at_utc AS TIMESTAMPTZ) < TIMESTAMPTZ '{NOW}+00' - INTERVAL 45 MINUTE)""",
    "copy_approvals": f"""{_W} SELECT docket_id, 2 AS review_version, review_decision, updated_at_utc, '1' AS copied_from FROM reviews WHERE coalesce(review_version, 0) = 1 AND lower(trim(review_decision)) = 'approved' AND docket_id IN (SELECT docket_id FROM artifacts WHERE review_version = 2)
 QUALIFY row_number() OVER (PARTITION BY docket_id ORDER BY updated_at_utc DESC NULLS LAST, reviewer_name ASC NULLS LAST) = 1""",
    "facts_parsed": f"{_W}, {_FACTS} SELECT input_id, CAST(json_array_length(facts) AS INT) AS n_facts, json_extract_string(facts, '$[0].support_strength') AS first_strength FROM p",
    "json_extract": "SELECT event_id, CASE WHEN event_id % 4 IN (0, 1) THEN CAST(json_extract(props, '$.k') AS INT) END AS k FROM events",
    "sentencing_lookup": f"""{_W}, y AS (SELECT CAST(docket_id AS VARCHAR) AS docket_id, sentencing_year, year_lookup_status FROM sentencing_year_map QUALIFY row_number() OVER (PARTITION BY docket_id ORDER BY sentencing_year DESC NULLS LAST, year_lookup_status ASC NULLS LAST) = 1)
 SELECT input_id, sentencing_year, coalesce(year_lookup_status, 'missing') AS year_status FROM latest_inputs LEFT JOIN y USING (docket_id)""",
    "case_year_enrich": f"""{_W}, s AS (SELECT docket_id, count(DISTINCT year(submitted_at)) AS n, min(year(submitted_at)) AS y, min('doc-' || lpad(CAST(input_id AS VARCHAR), 9, '0')) AS f FROM latest_inputs WHERE docket_id IS NOT NULL GROUP BY 1),
 k AS (SELECT CAST(docket_id AS VARCHAR) AS docket_id, max(sentencing_year) AS mapped FROM sentencing_year_map WHERE sentencing_year IS NOT NULL GROUP BY 1)
 SELECT decision_id, CASE WHEN n = 1 THEN y WHEN n IS NULL THEN mapped END AS case_year, CASE WHEN n = 1 THEN f END AS document_id, CASE WHEN n = 1 THEN 'matched' WHEN n > 1 THEN 'ambiguous' WHEN mapped IS NOT NULL THEN 'mapped' ELSE 'missing' END AS status FROM reviews LEFT JOIN s USING (docket_id) LEFT JOIN k USING (docket_id)""",
    "value_resolve": """WITH v AS (SELECT o_custkey AS c, year(o_orderdate) AS y, o_orderstatus AS v FROM orders WHERE o_orderstatus <> 'O'), e AS (SELECT c, y, count(DISTINCT v) AS n, min(v) AS v FROM v GROUP BY ALL), t AS (SELECT c, count(DISTINCT v) AS n, min(v) AS v FROM v GROUP BY ALL)
 SELECT c_custkey AS docket_id, CASE WHEN e.n = 1 THEN e.v WHEN e.n IS NULL AND t.n = 1 THEN t.v END AS value, CASE WHEN e.n = 1 THEN 'exact' WHEN e.n > 1 THEN 'exact_conflict' WHEN t.n = 1 THEN 'docket' WHEN t.n > 1 THEN 'docket_conflict' ELSE 'missing' END AS status FROM customer LEFT JOIN e ON e.c = c_custkey AND e.y = c_custkey % 6 + 1995 LEFT JOIN t ON t.c = c_custkey""",
    "overlay_accept": "SELECT o_custkey AS docket_id, o_orderkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN 'X' END, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderstatus END) AS flag, c_mktsegment AS acceptance_reason FROM orders LEFT JOIN customer ON c_custkey = o_custkey",
    "manifest_status": f"WITH {_MANIFEST} SELECT source_pdf_path, CASE WHEN bool_or(error_type IS NOT NULL) THEN 'failed' WHEN bool_or(content_length IS NOT NULL) THEN 'skipped_existing' ELSE 'exported' END AS status, max(content_length) AS content_length FROM m WHERE source_pdf_path IS NOT NULL GROUP BY 1",
    "manifest_counts": f"WITH {_MANIFEST} SELECT status, count(*) AS n FROM m GROUP BY 1",
    "pending_dockets": f"{_W} SELECT DISTINCT CAST(docket_id AS VARCHAR) AS docket_id FROM sentencing_year_map WHERE CAST(docket_id AS VARCHAR) NOT IN (SELECT docket_id FROM artifacts WHERE review_version = 1)",
    "path_dockets": rf"WITH {_MANIFEST} SELECT manifest_id, nullif(regexp_extract(source_pdf_path, '^/Volumes/sentencing/+([0-9]+)/', 1), '') AS docket, regexp_replace(regexp_extract(output_json_path, '[^/]*$'), '\.docintel\.json$', '') AS document FROM m",
    "case_texts": f"""WITH RECURSIVE {REVIEW_SQL}, b AS (SELECT docket_id, row_number() OVER (PARTITION BY docket_id ORDER BY lpad(CAST(input_id AS VARCHAR), 9, '0')) AS i, lpad(CAST(input_id AS VARCHAR), 9, '0') AS f, source_run_id AS s, case_summary AS t FROM latest_inputs WHERE docket_id IS NOT NULL),
 k AS (SELECT docket_id, i, regexp_replace('Document ' || i || ': ' || f || chr(10) || 'Source PDF: ' || coalesce(nullif(s, ''), 'unknown') || chr(10) || 'Full text:' || chr(10) || regexp_replace(coalesce(t, ''), {_ENDS}, '', 'g'), {_ENDS}, '', 'g') AS x FROM b),
 w(docket_id, i, used, txt) AS (SELECT DISTINCT docket_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), '' FROM k
  UNION ALL SELECT w.docket_id, k.i, w.used + 2 + length(CASE WHEN length(x) > 3000 - used THEN regexp_replace(substr(x, 1, 3000 - used), '[\\s\\pZ]+$', '') ELSE x END), w.txt || CASE WHEN w.i > 0 THEN chr(10) || chr(10) ELSE '' END || CASE WHEN length(x) > 3000 - used THEN regexp_replace(substr(x, 1, 3000 - used), '[\\s\\pZ]+$', '') ELSE x END
  FROM w JOIN k ON k.docket_id = w.docket_id AND k.i = w.i + 1 WHERE w.used < 3000),
 e AS (SELECT docket_id, regexp_replace(arg_max(txt, i), {_ENDS}, '', 'g') AS txt FROM w GROUP BY 1)
 SELECT docket_id, length(txt) AS n, md5(txt) AS digest FROM e""",
    "fact_clean": rf"""{_W}, {_FACTS}, u AS (SELECT input_id, i, regexp_replace(regexp_replace(coalesce(json_extract_string(facts, '$[' || (i - 1) || '].fact'), ''), '[\s\pZ\x0b\x85\x1c-\x1f]+', ' ', 'g'), '^ | $', '', 'g') AS x FROM (SELECT input_id, facts, unnest(generate_series(1, CAST(json_array_length(facts) AS BIGINT))) AS i FROM p WHERE facts IS NOT NULL)),
 k AS (SELECT * FROM u WHERE x <> '' AND NOT ({" OR ".join(f"contains(lower(x), '{w}')" for w in LEAKY)}) QUALIFY row_number() OVER (PARTITION BY input_id, lower(x) ORDER BY i) = 1),
 g AS (SELECT input_id, CAST(count(*) AS INT) AS n, md5(string_agg(x, chr(10) ORDER BY i)) AS digest FROM k GROUP BY 1)
 SELECT input_id, CASE WHEN facts IS NOT NULL THEN coalesce(n, 0) END AS n, CASE WHEN facts IS NOT NULL THEN coalesce(digest, md5('')) END AS digest FROM p LEFT JOIN g USING (input_id)""",
}
