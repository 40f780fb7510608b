"""Review pipeline tables: artifacts, final records, queue with carry-forward, claims, decisions, approved releases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.text import bullets, json_object, one_line, stale, strip_ws
from paperloom.operators.selection import hash_order, latest
from paperloom.operators.store import align, update_approvals, version_of

FACT = "struct<fact:string,source_document:string,evidence_excerpt:string,support_strength:string>"
ARTIFACT = (
    "docket_id string, docket_support_status string, queue_label string, selected_documents array<struct<document_id:string,source_file_name:string,document_role:string,why_selected:string>>, "
    f"case_facts array<{FACT}>, offense_level_steps array<struct<step_name:string,claim:string,guideline_reference:string,proposed_adjustment:int,included_in_total_offense_level:boolean,support_strength:string>>, final_total_offense_level int"
)
CLAIM_MINUTES = 45


def facts_of(text: Column) -> Column:
    """Array of facts from JSON text: an object with ``case_facts``, a list of facts, or either in code fences; text that is
    cut off or no JSON gives null."""
    t = strip_ws(F.regexp_replace(strip_ws(text), r"^```(?:json|JSON)?\s*|\s*```$", ""))
    good = F.try_parse_json(t).isNotNull()
    as_list = F.from_json(F.when(good & t.startswith("["), t), f"array<{FACT}>")
    as_object = F.from_json(F.when(good & t.startswith("{"), t), f"case_facts array<{FACT}>")["case_facts"]
    return F.coalesce(as_list, as_object)


def clean_facts(facts: Column, leaky: list[str]) -> Column:
    """Fact texts on one line, without blank ones and those that hold a leaky phrase; of spellings that differ in case the
    first stays, in order."""
    texts = F.transform(facts, lambda f: one_line(F.coalesce(f["fact"], F.lit(""))))
    kept = F.filter(texts, lambda t: (t != "") & ~F.exists(F.array(*map(F.lit, leaky)), lambda p: F.contains(F.lower(t), p)) if leaky else (t != ""))
    low = F.transform(kept, F.lower)
    return F.filter(kept, lambda t, i: F.array_position(low, F.lower(t)) == i + 1)


def weak_step(steps: Column) -> Column:
    """Whether an included step has weak support."""
    return F.coalesce(F.exists(steps, lambda s: s["included_in_total_offense_level"] & (F.lower(F.trim(s["support_strength"])) == "weak")), F.lit(False))


def artifact_records(raw: DataFrame) -> DataFrame:
    """Flat records from (docket_id, generated_at_utc, review_version, source_run_id, answer); answers without a JSON object
    are left out."""
    parsed = raw.withColumn("artifact_json", json_object(F.col("answer"))).where("artifact_json is not null").withColumn("a", F.from_json("artifact_json", ARTIFACT))
    n = lambda c: F.coalesce(F.size(F.col("a")[c]), F.lit(0))
    return parsed.select(
        "docket_id", "generated_at_utc", F.col("generated_at_utc").alias("updated_at_utc"), F.col("a.docket_support_status").alias("docket_support_status"), F.col("a.queue_label").alias("queue_label"), F.col("a.final_total_offense_level").alias("final_total_offense_level"),
        n("selected_documents").alias("selected_document_count"), n("offense_level_steps").alias("offense_level_step_count"), n("case_facts").alias("case_facts_count"), version_of().alias("review_version"), "source_run_id", "artifact_json",
    )


def final_records(artifacts: DataFrame, leaky: list[str]) -> DataFrame:
    """Records for the final table: supported dockets with a level, at least one clean fact and no weak included step."""
    a = artifacts.withColumn("a", F.from_json("artifact_json", ARTIFACT)).withColumn("facts", clean_facts(F.col("a.case_facts"), leaky))
    good = (F.lower(F.trim("docket_support_status")) == "supported") & ~weak_step(F.col("a.offense_level_steps")) & F.col("a.final_total_offense_level").isNotNull() & (F.size("facts") > 0)
    return a.where(good).select("docket_id", "generated_at_utc", "updated_at_utc", "docket_support_status", "queue_label", F.to_json("facts").alias("input_case_facts_json"), bullets(F.col("facts")).alias("input_case_facts_text"), F.size("facts").alias("input_case_fact_count"), F.col("a.final_total_offense_level").alias("ground_truth_offense_level"), "review_version", "source_run_id")


# What a queue row takes from its review, and the same with what a released claim leaves in it.
REVIEW_FIELDS = ("reviewer_name", "claim_status", "claim_token", "claimed_at_utc", "review_decision", "review_notes", "verification_json")
RELEASED = {c: "available" if c == "claim_status" else "" for c in REVIEW_FIELDS}


def review_queue(artifacts: DataFrame, reviews: DataFrame, version: int, supported_only: bool = True) -> DataFrame:
    """Artifacts of a version that have a level (and are supported, unless all are wanted), with all their columns and the
    fields of their review: of that version, else the completed one of another version (the highest, then the latest),
    marked as carried forward. ``review_source_version`` is the version the fields come from."""
    queue = artifacts.where((version_of() == version) & F.col("final_total_offense_level").isNotNull())
    if supported_only:
        queue = queue.where(F.lower(strip_ws(F.coalesce("docket_support_status", F.lit("")))) == "supported")
    own = version_of() == version
    done = F.lower(strip_ws(F.coalesce("claim_status", F.lit("")))) == "completed"
    usable = reviews.where(own | done).withColumn("_own", own)
    one = latest(usable, ["docket_id"], [F.col("_own").desc(), version_of().desc(), F.col("updated_at_utc").desc_nulls_last(), F.col("review_decision").asc_nulls_last()])
    said = one.select("docket_id", *(F.col(c).alias(f"_{c}") for c in REVIEW_FIELDS), F.col("review_version").alias("_source"), (~F.col("_own")).alias("_carried"))
    joined = queue.join(said, "docket_id", "left")
    kept = [c for c in artifacts.columns if c not in REVIEW_FIELDS]
    return joined.select(*kept, *(F.col(f"_{c}").alias(c) for c in REVIEW_FIELDS), F.col("_source").alias("review_source_version"), F.coalesce("_carried", F.lit(False)).alias("review_carried_forward"))


def claimable(queue: DataFrame, token: str, now: Column, minutes: int = CLAIM_MINUTES) -> DataFrame:
    """Queue rows that a token may claim: not completed, and free, its own, or claimed too long ago."""
    status = F.lower(F.trim(F.coalesce("claim_status", F.lit(""))))
    free = (F.coalesce(F.trim("reviewer_name"), F.lit("")) == "") | (status != "claimed") | (F.col("claim_token") == token) | stale(F.col("claimed_at_utc"), now, minutes)
    return queue.where((status != "completed") & free)


def claim_next(queue: DataFrame, token: str, reviewer: str, now: Column, seed: int = 0) -> DataFrame:
    """The claim row of one eligible docket, chosen by hash; no row if none is."""
    chosen = claimable(queue, token, now).orderBy(hash_order(["docket_id"], seed), "docket_id").limit(1)
    stamp = F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    return chosen.select("docket_id", F.lit(reviewer).alias("reviewer_name"), F.lit("claimed").alias("claim_status"), F.lit(token).alias("claim_token"), stamp.alias("claimed_at_utc"), stamp.alias("updated_at_utc"))


def release(reviews: DataFrame, requests: DataFrame, version: int, now: Column, minutes: int = CLAIM_MINUTES) -> DataFrame:
    """Reviews with the claims given up that ``requests`` (docket_id, claim_token) name, in one version; others stay.

    A row that another token has claimed not long ago is kept; any other row of the docket and version becomes available,
    its reviewer, claim, decision, notes and verification are emptied and its time of change is ``now``. Requests and
    tokens are stripped; blank ones are ignored; several tokens for one docket release it if one of them may.
    """
    asked = requests.select(strip_ws(F.col("docket_id").cast("string")).alias("docket_id"), strip_ws(F.col("claim_token")).alias("_token")).where("docket_id <> '' and _token <> ''")
    tokens = asked.groupBy("docket_id").agg(F.collect_set("_token").alias("_tokens"))
    joined = reviews.join(tokens, "docket_id", "left")
    held = (F.coalesce("claim_status", F.lit("")) == "claimed") & ~F.array_contains("_tokens", F.coalesce("claim_token", F.lit(""))) & ~stale(F.col("claimed_at_utc"), now, minutes)
    freed = F.col("_tokens").isNotNull() & (version_of() == version) & ~F.coalesce(held, F.lit(False))
    changes = {c: F.when(freed, v).otherwise(F.col(c)) for c, v in RELEASED.items()}
    changes["updated_at_utc"] = F.when(freed, F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")).otherwise(F.col("updated_at_utc"))
    return joined.withColumns(changes).select(*reviews.columns)


def completed(reviews: DataFrame) -> DataFrame:
    """The latest completed decision per docket and version, in the form ``update_approvals`` takes."""
    done = reviews.where(F.lower(F.trim(F.coalesce("claim_status", F.lit("")))) == "completed").withColumn("review_version", version_of())
    one = latest(done, ["docket_id", "review_version"], [F.col("updated_at_utc").desc_nulls_last(), F.col("review_decision").asc_nulls_last(), F.col("reviewer_name").asc_nulls_last()])
    return one.select("docket_id", "review_version", "review_decision", F.col("updated_at_utc").alias("reviewed_at_utc"), F.col("reviewer_name").alias("approved_by"))


def replay(final: DataFrame, reviews: DataFrame, version: int) -> DataFrame:
    """Completed decisions brought into the final table's rows of a version, in one join."""
    return update_approvals(final, completed(reviews).where(F.col("review_version") == version))


def copy_approvals(reviews: DataFrame, target: DataFrame, source_version: int, target_version: int, now: Column) -> DataFrame:
    """Approved reviews of one version as reviews of another, for dockets the target has in it; provenance is noted in the
    verification JSON."""
    approved = latest(reviews.where((version_of() == source_version) & (F.lower(F.trim("review_decision")) == "approved")), ["docket_id"], [F.col("updated_at_utc").desc_nulls_last(), F.col("reviewer_name").asc_nulls_last()])
    there = target.where(version_of() == target_version).select("docket_id").distinct()
    note = F.to_json(F.struct(F.lit(source_version).alias("copied_from_version"), F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("copied_at_utc"), F.col("verification_json").alias("original")))
    moved = approved.join(there, "docket_id", "left_semi").withColumns({"verification_json": note, "review_version": F.lit(target_version)})
    return align(moved, reviews)


def approved_release(final: DataFrame, reviews: DataFrame) -> DataFrame:
    """(docket_id, input, output) of dockets with an approved review and a usable final row: of each the row of the highest
    version, then the latest review, change and generation."""
    said = reviews.where(F.lower(F.trim(F.coalesce("review_decision", F.lit("")))) == "approved").select("docket_id").distinct()
    usable = final.where((F.trim(F.coalesce("input_case_facts_text", F.lit(""))) != "") & F.col("ground_truth_offense_level").isNotNull())
    order = [F.col(c).desc_nulls_last() for c in ("review_version", "reviewed_at_utc", "updated_at_utc", "generated_at_utc", "source_run_id")]
    one = latest(usable.join(said, "docket_id", "left_semi"), ["docket_id"], order)
    return one.select("docket_id", F.col("input_case_facts_text").alias("input"), F.col("ground_truth_offense_level").alias("output"))


def approved_without_row(final: DataFrame, reviews: DataFrame) -> DataFrame:
    """Approved dockets that the release lacks."""
    said = reviews.where(F.lower(F.trim(F.coalesce("review_decision", F.lit("")))) == "approved").select("docket_id").distinct()
    return said.join(approved_release(final, reviews), "docket_id", "left_anti")


def pending(dockets: DataFrame, artifacts: DataFrame, version: int, refresh: bool = False) -> DataFrame:
    """Dockets to work on: all of them when refreshing, else those without an artifact of the version."""
    return dockets if refresh else dockets.join(artifacts.where(version_of() == version).select("docket_id"), "docket_id", "left_anti")


def merge_facts(artifact_json: Column, facts: Column) -> Column:
    """The artifact (JSON text) with its ``case_facts`` replaced; every other field stays as it is, unknown ones too. Null
    facts are an empty list; an artifact that is no JSON object gives null."""
    fields = F.from_json(artifact_json, "map<string,variant>")
    new = F.create_map(F.lit("case_facts"), F.parse_json(F.to_json(F.coalesce(facts, F.from_json(F.lit("[]"), f"array<{FACT}>")))))
    return F.to_json(F.map_concat(F.map_filter(fields, lambda k, _: k != "case_facts"), new))


def export_status(sources: DataFrame, outputs: DataFrame, failures: DataFrame) -> DataFrame:
    """Manifest rows of an export run: failed, skipped_existing or exported for each source path."""
    done = outputs.select("source_pdf_path", F.lit(1).alias("_done"), "page_count", "content_length").dropDuplicates(["source_pdf_path"])
    bad = failures.select("source_pdf_path", F.lit(1).alias("_bad"), "error_type", "error_message").dropDuplicates(["source_pdf_path"])
    status = F.when(F.col("_bad") == 1, "failed").when(F.col("_done") == 1, "skipped_existing").otherwise("exported")
    return sources.join(done, "source_pdf_path", "left").join(bad, "source_pdf_path", "left").withColumn("status", status).drop("_done", "_bad")


def case_texts(documents: DataFrame, budget: int | None = None) -> DataFrame:
    """(docket_id, text): the documents of a docket (document_id, source_file_name, source_pdf_path, text) in the order of
    their ids, each under a header with its number, file and source, parted by blank lines.

    Blocks and the two characters between them are charged to the character budget; a block that passes what is left is
    cut there and loses white space at its end; documents beyond the budget are left out.
    """
    if budget is not None and budget < 1:
        raise ValueError("budget must be at least 1")
    said = lambda *names: F.coalesce(*(F.nullif(F.col(n).cast("string"), F.lit("")) for n in names), F.lit("unknown"))
    number = F.row_number().over(Window.partitionBy("docket_id").orderBy("document_id"))
    body = F.concat(F.lit("Document "), F.col("_i").cast("string"), F.lit(": "), said("source_file_name", "document_id"), F.lit("\nSource PDF: "), said("source_pdf_path"), F.lit("\nFull text:\n"), strip_ws(F.coalesce("text", F.lit(""))))
    rows = documents.withColumn("_i", number)
    block = strip_ws(body)
    if budget is not None:  # every document takes three characters at least, and no more than the budget
        rows, block = rows.where(F.col("_i") <= budget // 3 + 1), F.substring(block, 1, budget + 1)
    blocks = rows.select("docket_id", F.struct("_i", block.alias("t")).alias("b")).groupBy("docket_id").agg(F.array_sort(F.collect_list("b")).alias("blocks"))
    if budget is None:
        return blocks.select("docket_id", strip_ws(F.array_join(F.transform("blocks", lambda b: b["t"]), "\n\n")).alias("text"))

    def add(so_far: Column, b: Column) -> Column:
        left = F.lit(budget) - so_far["used"]
        piece = F.when(F.length(b["t"]) > left, strip_ws(F.concat(F.lit("x"), F.substr(b["t"], F.lit(1), left)))).otherwise(F.concat(F.lit("x"), b["t"]))  # the x keeps its beginning from being stripped
        piece = F.substr(piece, F.lit(2))
        return F.when(left <= 0, so_far).otherwise(F.struct(F.concat(so_far["parts"], F.array(piece)).alias("parts"), (so_far["used"] + F.length(piece) + 2).alias("used")))

    nothing = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).alias("used"))
    return blocks.select("docket_id", strip_ws(F.array_join(F.aggregate("blocks", nothing, add)["parts"], "\n\n")).alias("text"))
