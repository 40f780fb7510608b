"""Lookups with a status instead of a silent miss, and overlays of one table over another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.operators.selection import latest


def overlay(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str], prefix: str, order: list) -> DataFrame:
    """``left`` with ``columns`` taken from ``right`` where it has a value, and the right's other columns under a prefix.

    The right side counts once per key, by ``order``.
    """
    one = latest(right, keys, order)
    other = [c for c in one.columns if c not in keys and c not in columns]
    r = one.select(*keys, *(F.col(c).alias(f"_r_{c}") for c in columns), *(F.col(c).alias(f"{prefix}{c}") for c in other))
    joined = left.join(r, keys, "left")
    return joined.select(*(F.coalesce(f"_r_{c}", c).alias(c) if c in columns else F.col(c) for c in left.columns), *(f"{prefix}{c}" for c in other))


def with_year(cases: DataFrame, years: DataFrame) -> DataFrame:
    """Cases with sentencing_year and year_status of the year map; ``missing`` where it has no row. One map row per docket."""
    one = latest(years, ["docket_id"], [F.col("sentencing_year").desc_nulls_last(), F.col("year_lookup_status").asc_nulls_last()])
    return cases.join(one.select("docket_id", "sentencing_year", "year_lookup_status"), "docket_id", "left").withColumn("year_status", F.coalesce("year_lookup_status", F.lit("missing"))).drop("year_lookup_status")


def case_year(cases: DataFrame, source: DataFrame, years: DataFrame) -> DataFrame:
    """Year and document of each case with a status.

    One distinct year in ``source``: matched, with the document of the row that has one, the lowest first. Several:
    ambiguous. None: mapped from the year map, or missing.
    """
    per = source.groupBy("docket_id").agg(F.count_distinct("year").alias("_n"), F.min("year").alias("_year"), F.min("document_id").alias("_document"))
    one_map = years.where("sentencing_year is not null").groupBy("docket_id").agg(F.max("sentencing_year").alias("_mapped"))
    n = F.coalesce("_n", F.lit(0))
    joined = cases.join(per, "docket_id", "left").join(one_map, "docket_id", "left")
    status = F.when(n == 1, "matched").when(n > 1, "ambiguous").when(F.col("_mapped").isNotNull(), "mapped").otherwise("missing")
    return joined.withColumns({"case_year": F.when(n == 1, F.col("_year")).when(n == 0, F.col("_mapped")), "document_id": F.when(n == 1, F.col("_document")), "status": status}).drop("_n", "_year", "_document", "_mapped")


def resolve_value(cases: DataFrame, values: DataFrame) -> DataFrame:
    """The value of each (docket_id, year): of the exact year if unique there, else of the docket if unique, else a conflict.

    status: exact, exact_conflict, docket, docket_conflict or missing. Null values say nothing.
    """
    known = values.where("value is not null")
    exact = known.groupBy("docket_id", "year").agg(F.count_distinct("value").alias("_ne"), F.min("value").alias("_ve"))
    docket = known.groupBy("docket_id").agg(F.count_distinct("value").alias("_nd"), F.min("value").alias("_vd"))
    joined = cases.join(exact, ["docket_id", "year"], "left").join(docket, "docket_id", "left")
    ne, nd = F.coalesce("_ne", F.lit(0)), F.coalesce("_nd", F.lit(0))
    status = F.when(ne == 1, "exact").when(ne > 1, "exact_conflict").when(nd == 1, "docket").when(nd > 1, "docket_conflict").otherwise("missing")
    return joined.withColumns({"value": F.when(ne == 1, F.col("_ve")).when((ne == 0) & (nd == 1), F.col("_vd")), "status": status}).drop("_ne", "_ve", "_nd", "_vd")


def status_counts(df: DataFrame, column: str = "status") -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))
