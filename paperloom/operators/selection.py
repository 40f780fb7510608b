"""Reproducible choices of rows: one per key, capped per group, sampled, paged, in requested order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in ``order``. The limit reaches below the shuffle (a window group limit)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def newest_first(*names: str) -> list[Column]:
    return [F.col(n).desc_nulls_last() for n in names]


def cap_per_group(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def hash_order(keys: list[str], seed: int) -> Column:
    """An order that looks random, depends on seed and key only and can be computed elsewhere (SHA-256 of ``seed:key:…``)."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)), 256)


def sample(df: DataFrame, keys: list[str], n: int = 1000, seed: int = 42) -> DataFrame:
    """``n`` rows in hash order, ties by key: the same for any partitioning."""
    return df.orderBy(hash_order(keys, seed), *keys).limit(n)


def page(df: DataFrame, order: list[Column], start: int = 0, n: int | None = None) -> DataFrame:
    """Rows from ``start``; ``n`` of them or all the rest."""
    if start < 0 or (n is not None and n < 0):
        raise ValueError("start and n must not be negative")
    rest = df.orderBy(*order).offset(start)
    return rest if n is None else rest.limit(n)


def in_requested_order(df: DataFrame, requests: DataFrame, keys: list[str]) -> DataFrame:
    """Rows for the requested keys with their place ``ord`` in the request; a key asked for twice comes twice."""
    return requests.select(*keys, "ord").join(df, keys, "inner")


def missing_requests(df: DataFrame, requests: DataFrame, keys: list[str]) -> DataFrame:
    return requests.join(df, keys, "left_anti")


def batches(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Batch number of each row, ``n`` rows a batch, the last one partial.

    Numbers run through range partitions with their counts added up, so no task orders the whole table: ranks inside
    a partition are local and the offsets are one number per partition.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    spread = df.repartitionByRange(parts, *keys).withColumn("_part", F.spark_partition_id())
    if df.isStreaming:
        raise ValueError("batches need a bounded table")
    from paperloom.session import materialize

    spread = materialize(spread, "batches")
    counts = spread.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_part")) - F.col("_n")).drop("_n")  # one row per partition
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*keys)) - 1
    return spread.withColumn("_local", local).join(offsets, "_part").withColumn("batch", F.floor((F.col("_before") + F.col("_local")) / n)).drop("_part", "_local", "_before")
