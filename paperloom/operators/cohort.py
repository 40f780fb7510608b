"""Strict cohort: admissions of given discharge years without any code that changed, with note and ordered codes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions.text import code_stored, year_bounds
from paperloom.operators.selection import latest


def diagnoses_of(df: DataFrame) -> DataFrame:
    """Current-version codes with an admission: hadm_id, subject_id, seq_num, icd_code (as stored), code (for joins)."""
    return df.where("icd_version = 10 and hadm_id is not null").select(F.col("hadm_id").try_cast("long"), F.col("subject_id").try_cast("long"), F.col("seq_num").try_cast("int"), "icd_code", code_stored(F.col("icd_code")).alias("code"))


def touched_admissions(diagnoses: DataFrame, codes: DataFrame) -> DataFrame:
    """Admissions that carry a changed code."""
    return diagnoses.join(codes, "code", "left_semi").select("hadm_id").distinct()


def discharge_years(admissions: DataFrame, patients: DataFrame) -> DataFrame:
    """Admissions with the range of real discharge years: the shift of dates is undone by the patient's anchor.

    Admissions without a discharge time are left out; a group text without years gives a null range.
    """
    a = admissions.select("subject_id", "hadm_id", F.try_to_timestamp(F.col("dischtime").cast("string")).alias("dischtime")).where("dischtime is not null")
    joined = a.join(patients.select("subject_id", F.col("anchor_year").try_cast("int"), "anchor_year_group"), "subject_id")
    offset = F.year("dischtime") - F.col("anchor_year")
    first, last = year_bounds(F.col("anchor_year_group"), offset)
    return joined.withColumns({"year_min": first, "year_max": last}).drop("anchor_year", "anchor_year_group")


def ordered_codes(diagnoses: DataFrame) -> DataFrame:
    """(hadm_id, codes): the codes of an admission by sequence number, then code; repeats stay, null numbers come first."""
    entries = F.sort_array(F.collect_list(F.struct("seq_num", F.col("icd_code").alias("icd_code"))))
    return diagnoses.groupBy("hadm_id").agg(F.transform(entries, lambda x: x["icd_code"]).alias("codes"))


def one_note(notes: DataFrame) -> DataFrame:
    """The first note of each admission by sequence number, then id."""
    return latest(notes.where("hadm_id is not null"), ["hadm_id"], [F.col("note_seq").asc_nulls_last(), F.col("note_id").asc()])


def eligible(admissions: DataFrame, patients: DataFrame, diagnoses: DataFrame, codes: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """Admissions whose whole range of years lies within the window, that have codes and none of the changed ones."""
    dated = discharge_years(admissions, patients).where((F.col("year_min") >= first_year) & (F.col("year_max") <= last_year))
    kept = latest(dated, ["hadm_id"], [F.col("dischtime"), F.col("subject_id")])
    return kept.join(diagnoses, "hadm_id", "left_semi").join(touched_admissions(diagnoses, codes), "hadm_id", "left_anti")


def note_coverage(cohort: DataFrame, notes: DataFrame) -> DataFrame:
    """One row: admissions, those with a note, those without and those with several."""
    counts = notes.where("hadm_id is not null").groupBy("hadm_id").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return cohort.select("hadm_id").distinct().join(counts, "hadm_id", "left").agg(F.count("*").alias("admissions"), F.count_if(n > 0).alias("with_note"), F.count_if(n == 0).alias("without_note"), F.count_if(n > 1).alias("several_notes"))


def strict_cohort(admissions: DataFrame, patients: DataFrame, diagnoses: DataFrame, notes: DataFrame, codes: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """hadm_id, subject_id, note_id, input_text, output_icd_codes, dischtime, real_discharge_year_min, real_discharge_year_max."""
    chosen = eligible(admissions, patients, diagnoses, codes, first_year, last_year)
    text = one_note(notes).select("hadm_id", "note_id", "text")
    return (
        chosen.join(text, "hadm_id")
        .join(ordered_codes(diagnoses.join(chosen.select("hadm_id"), "hadm_id", "left_semi")), "hadm_id")
        .select("hadm_id", "subject_id", "note_id", F.col("text").alias("input_text"), F.col("codes").alias("output_icd_codes"), "dischtime", F.col("year_min").alias("real_discharge_year_min"), F.col("year_max").alias("real_discharge_year_max"))
    )


def cohort_summary(cohort: DataFrame) -> DataFrame:
    """Counts of the finished table in one pass."""
    return cohort.agg(F.count("*").alias("n_rows"), F.count_distinct("hadm_id").alias("n_admissions"), F.count_distinct("subject_id").alias("n_subjects"), F.sum(F.size("output_icd_codes")).alias("n_codes"), F.count_if(F.length("input_text") == 0).alias("n_empty_texts"))
