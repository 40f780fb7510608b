"""Joins whose left side may hold very many rows of one key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of one key that may share a task, and classes of keys for which a number of salts is kept.
ROWS_PER_SALT, BUCKETS = 50_000, 4096


def _bucket(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def salts_for(counts: DataFrame, keys: list[str], n: str = "n", rows_per_salt: int = ROWS_PER_SALT) -> Column:
    """Salts for a row by its keys, from the number of rows of each key (``counts``: keys and ``n``).

    Kept per class of keys, the most any key of it needs, so the driver holds ``BUCKETS`` numbers however many keys there
    are; both sides of a join compute the same number from the keys alone.
    """
    need = counts.groupBy(_bucket(keys).alias("bucket")).agg(F.ceil(F.max(n) / F.lit(rows_per_salt)).cast("int").alias("salts")).where("salts > 1").collect()
    if not need:
        return F.lit(1)
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(int(v)) for r in need for v in r)), _bucket(keys)), F.lit(1))


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", salts: Column | None = None) -> DataFrame:
    """``left`` joined to ``right`` on ``keys``, the rows of a busy key spread over several tasks and its few partners on the
    right copied to each. ``right`` holds few rows per key. For inner, left, left_semi and left_anti joins."""
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"a salted join cannot be {how}")
    n = salts if salts is not None else salts_for(left.groupBy(*keys).agg(F.count("*").alias("n")), keys)
    own = left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), n).cast("int"))
    copied = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), n - 1)))
    return own.join(copied, [*keys, "_salt"], how).drop("_salt")
