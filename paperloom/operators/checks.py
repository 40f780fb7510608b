"""Guards: required columns, optional columns, existing tables, paired change lines."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def require_columns(df: DataFrame, names: Iterable[str], what: str = "table") -> DataFrame:
    """``df`` itself, or an error that lists the missing columns in order."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"{what} lacks the columns {', '.join(missing)}")
    return df


def optional(df: DataFrame, name: str, type_name: str) -> Column:
    """The column cast to a type, or a typed null where the table has no such column."""
    return F.col(f"`{name}`").try_cast(type_name) if name in df.columns else F.lit(None).cast(type_name)


def resolve_column(df: DataFrame, candidates: Iterable[str]) -> str:
    """The first of the candidate names that the table has, whatever its case."""
    have = {c.lower(): c for c in df.columns}
    for c in candidates:
        if c.lower() in have:
            return have[c.lower()]
    raise ValueError(f"none of the columns {', '.join(candidates)}")


def require_table(spark: SparkSession, name: str) -> DataFrame:
    if not spark.catalog.tableExists(name):
        raise ValueError(f"no table or view {name}")
    return spark.table(name)


def align(df: DataFrame, target: DataFrame) -> DataFrame:
    """``df`` with the target's columns in the target's order and types; columns it lacks are null."""
    return df.select(*(optional(df, f.name, f.dataType.simpleString()).alias(f.name) for f in target.schema.fields))


def add_missing(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Columns the table lacks, whatever their case, as typed nulls at its end."""
    have = {c.lower() for c in df.columns}
    return df.withColumns({n: F.lit(None).cast(t) for n, t in columns.items() if n.lower() not in have})


# Prefixes of the lines of a code change file.
PREFIXES = ("Add:", "Delete:", "Revise from:", "Revise to:")


def change_lines(lines: DataFrame) -> DataFrame:
    """(file, line, kind, code) of the lines that carry a change; ``lines`` has file, line, text. Codes lose their dot."""
    from paperloom.functions.text import code_listed, first_token

    kind = F.regexp_extract("text", r"^\s*(Add|Delete|Revise from|Revise to):", 1)
    rest = F.regexp_replace("text", r"^\s*(?:Add|Delete|Revise from|Revise to):", "")
    return lines.select("file", "line", kind.alias("kind"), code_listed(first_token(rest)).alias("code")).where("kind <> ''")


def unpaired_revisions(changes: DataFrame) -> DataFrame:
    """Violations: a ``Revise from`` without the ``Revise to`` of the same code behind it, a ``Revise to`` without its
    ``Revise from``, a change without a code. Each file is ordered by itself; an empty result is a valid input."""
    w = Window.partitionBy("file").orderBy("line")
    near = changes.withColumns({"next_kind": F.lead("kind").over(w), "next_code": F.lead("code").over(w), "last_kind": F.lag("kind").over(w)})
    problem = (
        F.when(F.col("code").isNull(), "no code")
        .when((F.col("kind") == "Revise from") & F.col("next_kind").isNull(), "unclosed")
        .when((F.col("kind") == "Revise from") & (F.col("next_kind") != "Revise to"), "unpaired")
        .when((F.col("kind") == "Revise from") & (F.col("next_code") != F.col("code")), "mismatched")
        .when((F.col("kind") == "Revise to") & ~F.coalesce(F.col("last_kind") == "Revise from", F.lit(False)), "unpaired")
    )
    return near.select("file", "line", "kind", "code", problem.alias("problem")).where("problem is not null")


def touched_codes(changes: DataFrame) -> DataFrame:
    """Distinct codes that any change touches."""
    return changes.where("code is not null").select("code").distinct()
