"""Evaluation runs: selectors of cases, views per experiment kind, and stages whose failures stay with their item."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.text import blank_to_null, nonblank_lines, strip_ws
from paperloom.operators.checks import require_columns, resolve_column
from paperloom.operators.lookups import with_year
from paperloom.operators.selection import latest

# Experiments by name, the kind of data each reads and its label.
EXPERIMENTS = {
    "icd-single-pass-rag": ("icd", "Single-pass RAG"),
    "icd-agentic-rag": ("icd", "Agentic RAG"),
    "icd-react-style-tool-use": ("icd", "ReAct-style tool use"),
    "icd-deepagents": ("icd", "Deep Agents skills"),
    "legal-single-pass-rag": ("legal_final", "Single-pass RAG"),
    "legal-agentic-rag": ("legal_final", "Agentic RAG"),
    "legal-react-style-tool-use": ("legal_review", "ReAct-style tool use"),
    "legal-deepagents": ("legal_final", "Deep Agents skills"),
}
# Columns of the two schemas of legal cases, and of coded ones.
STRICT_COLUMNS = ("year", "docket_id", "case_facts_summary", "offense_level_total")
FINAL_COLUMNS = ("docket_id", "input", "output")
CODED_COLUMNS = ("hadm_id", "subject_id", "note_id", "input_text", "output_icd_codes")
# Fields of a case record that a prompt may show.
SAFE_FIELDS = ("acceptance_of_responsibility",)


def case_key(year: Column, docket: Column) -> Column:
    """(year, docket): a year that is blank is null, one that is no number an error; the docket is stripped, null is ''."""
    text = blank_to_null(year)
    return F.struct(F.when(text.isNotNull(), text.cast("int")).alias("year"), strip_ws(F.coalesce(docket.cast("string"), F.lit(""))).alias("docket_id"))


def by_year_nulls_last(year: str = "year", docket: str = "docket_id") -> list[Column]:
    """Order of selectors: known years first, then the docket as text."""
    return [F.col(year).isNull(), F.coalesce(year, F.lit(0)), strip_ws(F.coalesce(F.col(docket).cast("string"), F.lit("")))]


def legal_selectors(cases: DataFrame, years: DataFrame | None = None, year: int | None = None, limit: int | None = None) -> DataFrame:
    """Cases to evaluate, by the schema of their table: strict rows carry their year, final rows get it from ``years``.

    Rows without input or answer are left out; a docket (and year) counts once, its lowest input; with ``year`` given,
    cases of an unknown year are left out too. Order: ``by_year_nulls_last``.
    """
    text = lambda c: strip_ws(F.coalesce(F.col(c).cast("string"), F.lit("")))
    if set(STRICT_COLUMNS) <= set(cases.columns):
        good = cases.where("case_facts_summary is not null and offense_level_total is not null")
        one = latest(good, ["year", "docket_id"], [F.col("case_facts_summary"), F.col("offense_level_total").cast("string")])
        document = [F.col("government_sm_doc_id")] if "government_sm_doc_id" in cases.columns else []
        out = one.select("year", text("docket_id").alias("docket_id"), *document, text("case_facts_summary").alias("case_summary"), text("offense_level_total").alias("expected_offense_level_total"))
    else:
        require_columns(cases, FINAL_COLUMNS, "case table")
        if years is None:
            raise ValueError("final rows need a table of years")
        one = latest(cases.where("input is not null and output is not null"), ["docket_id"], [F.col("input"), F.col("output").cast("string")])
        keyed = one.select(text("docket_id").alias("docket_id"), text("input").alias("case_summary"), text("output").alias("expected_offense_level_total"))
        found = with_year(keyed, years.withColumn("docket_id", text("docket_id")))
        out = found.select(F.col("sentencing_year").cast("int").alias("year"), "docket_id", "case_summary", "expected_offense_level_total", F.col("year_status").alias("case_year_lookup_status"))
    if year is not None:
        out = out.where(F.col("year") == year)
    ordered = out.orderBy(*by_year_nulls_last())
    return ordered if limit is None else ordered.limit(limit)


def prompt_fields(record: DataFrame, keep: tuple[str, ...] = SAFE_FIELDS) -> DataFrame:
    """The fields a prompt may show, strings stripped and blank ones null; fields the record lacks are left out."""
    names = [c for c in keep if c in record.columns]
    return record.select(*((blank_to_null(F.col(c)) if record.schema[c].dataType.simpleString() == "string" else F.col(c)).alias(c) for c in names))


# --- views per experiment kind


def final_dataset(rows: DataFrame) -> DataFrame:
    """(docket_id long, input, output) of a release in either naming; incomplete rows are left out, a docket counts once."""
    docket, given, answer = (resolve_column(rows, names) for names in (["docket_id"], ["input", "input_case_facts_text"], ["output", "ground_truth_offense_level"]))
    flat = rows.select(F.col(docket).try_cast("long").alias("docket_id"), F.col(given).cast("string").alias("input"), F.col(answer).cast("string").alias("output"))
    return latest(flat.where("docket_id is not null and input is not null and output is not null"), ["docket_id"], [F.col("input"), F.col("output")])


def year_view(rows: DataFrame) -> DataFrame:
    """(docket_id long, sentencing_year, year_lookup_status) of a year map in any of its namings, a docket once."""
    docket, year = resolve_column(rows, ["docket_id"]), resolve_column(rows, ["sentencing_year", "guideline_year", "year"])
    status = next((F.col(c) for n in ("year_lookup_status", "lookup_status", "source") for c in rows.columns if c.lower() == n), F.lit("local_csv"))
    flat = rows.select(F.col(docket).try_cast("long").alias("docket_id"), F.col(year).try_cast("int").alias("sentencing_year"), status.cast("string").alias("year_lookup_status"))
    return latest(flat.where("docket_id is not null and sentencing_year is not null"), ["docket_id"], [F.col("sentencing_year").desc(), F.col("year_lookup_status").asc_nulls_last()])


def review_view(dataset: DataFrame, years: DataFrame, version: int) -> DataFrame:
    """The release with its years as rows of a reviewed table; answers that are no numbers are left out."""
    joined = dataset.join(years, "docket_id")
    out = joined.select(
        "docket_id", F.col("sentencing_year").alias("guideline_year"), F.col("input").alias("input_case_facts_text"), nonblank_lines(F.col("input")).alias("input_case_fact_count"), F.col("output").try_cast("int").alias("ground_truth_offense_level"),
        F.lit("approved_release").alias("queue_label"), F.lit(True).alias("approved"), F.lit("approved").alias("review_decision"), F.lit(version).alias("review_version"), F.lit("approved_release_csv").alias("source_run_id"),
    )
    return out.where("ground_truth_offense_level is not null")


def case_source_view(years: DataFrame) -> DataFrame:
    """Dockets with their years as a case source without documents."""
    return years.select("docket_id", F.col("sentencing_year").alias("year"), F.lit(None).cast("long").alias("government_sm_doc_id"), F.lit(None).cast("boolean").alias("acceptance_of_responsibility"))


def experiment_views(name: str, dataset: DataFrame, years: DataFrame | None = None, version: int = 0) -> dict[str, DataFrame]:
    """The tables an experiment reads, by role, made from its dataset and year map."""
    if name not in EXPERIMENTS:
        raise ValueError(f"no experiment {name}; there are {', '.join(sorted(EXPERIMENTS))}")
    kind = EXPERIMENTS[name][0]
    if kind == "icd":
        return {"cases": require_columns(dataset, CODED_COLUMNS, "coded dataset")}
    if years is None:
        raise ValueError(f"{name} needs a year map")
    final, mapped = final_dataset(dataset), year_view(years)
    if kind == "legal_final":
        return {"cases": final, "years": mapped}
    return {"cases": review_view(final, mapped, version), "case_source": case_source_view(mapped), "years": mapped}


# --- stages with a status per item


def run_stage(items: DataFrame, stage: Callable[[dict], str | None], out: str, status: str = "status", error: str = "error", only: Column | None = None) -> DataFrame:
    """``items`` with the stage's answer per row; a row that fails has status ``error`` and its message, the run goes on.

    Rows outside ``only`` are not run: status ``skipped``. A stage is outside code (a model call), hence Python.
    """
    source = items.withColumn("_run", F.coalesce(only, F.lit(False)) if only is not None else F.lit(True))
    names = items.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields) + f", `{out}` string, `{status}` string, `{error}` string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = []
            for row, wanted in zip(frame[names].to_dict("records"), frame["_run"]):
                if not wanted:
                    made.append((None, "skipped", None))
                    continue
                try:
                    made.append((stage(row), "ok", None))
                except Exception as problem:  # kept with its item
                    made.append((None, "error", f"{type(problem).__name__}: {problem}"))
            yield frame[names].assign(**{c: [m[i] for m in made] for i, c in enumerate((out, status, error))})

    return source.mapInPandas(run, schema)


def two_stages(items: DataFrame, primary: Callable[[dict], str], facts: Callable[[dict], str], existing: str | None = None) -> DataFrame:
    """Primary stage, then the facts stage for its successes; columns artifact, primary_status, primary_error, facts,
    facts_status, facts_error. Where the column ``existing`` holds an artifact, it is taken instead of a primary run."""
    todo = F.lit(True) if existing is None else F.col(existing).isNull()
    first = run_stage(items, primary, "_made", "primary_status", "primary_error", todo)
    have = first.withColumn("artifact", F.col("_made") if existing is None else F.coalesce("_made", existing)).drop("_made")
    return run_stage(have, facts, "facts", "facts_status", "facts_error", F.col("artifact").isNotNull())
