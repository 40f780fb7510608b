"""Keyed tables as copy-on-write Parquet versions: upsert, preserving upsert, keyed update, retry on conflict.

A table is a folder of versions and a pointer file that names the current one; a writer writes a new version and then
creates the next pointer, which fails if another writer was faster. Readers see whole versions only.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators.checks import align

ATTEMPTS, DELAY = 5, 0.25
# Fixed value: columns a reviewer owns in the final table.
REVIEWER_COLUMNS = ("approved", "review_decision", "reviewed_at_utc", "approved_by")


class Conflict(RuntimeError):
    """Another writer committed first."""


def version_of(c: str = "review_version") -> Column:
    """The review version; a missing one is 0."""
    return F.coalesce(F.col(c), F.lit(0))


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumn("_version", version_of())


def require_unique(source: DataFrame) -> None:
    """An upsert's source must hold one row per key; anti-join and union would otherwise duplicate silently."""
    if not _keyed(source).groupBy("docket_id", "_version").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        raise ValueError("the source holds several rows for one docket and version")


def upsert(target: DataFrame, source: DataFrame) -> DataFrame:
    """Source rows replace target rows of the same docket and version; the others are added."""
    new = align(source, target)
    kept = _keyed(target).join(_keyed(new).select("docket_id", "_version"), ["docket_id", "_version"], "left_anti").drop("_version")
    return kept.select(*target.columns).unionByName(new)


def upsert_preserving(target: DataFrame, source: DataFrame, preserve: tuple[str, ...] = REVIEWER_COLUMNS, first: str = "generated_at_utc") -> DataFrame:
    """As ``upsert``, but a matched row keeps the target's reviewer columns and its first time of generation."""
    new = align(source, target)
    t = _keyed(target).select("docket_id", "_version", F.lit(1).alias("_old"), *(F.col(c).alias(f"_t_{c}") for c in target.columns))
    s = _keyed(new).select("docket_id", "_version", F.lit(1).alias("_new"), *(F.col(c).alias(f"_s_{c}") for c in target.columns))
    both = t.join(s, ["docket_id", "_version"], "full")

    def value(c: str) -> Column:
        if c in preserve:
            return F.when(F.col("_old") == 1, F.col(f"_t_{c}")).otherwise(F.col(f"_s_{c}"))
        if c == first:
            return F.coalesce(f"_t_{c}", f"_s_{c}")
        return F.when(F.col("_new") == 1, F.col(f"_s_{c}")).otherwise(F.col(f"_t_{c}"))

    return both.select(*(value(c).alias(c) for c in target.columns))


def update_approvals(final: DataFrame, decisions: DataFrame) -> DataFrame:
    """Approval columns of the rows a decision names; ``decisions`` has docket_id, review_version, review_decision,
    reviewed_at_utc, approved_by and one row per docket and version. Approved means the decision is ``approved`` in any case."""
    d = _keyed(decisions).select("docket_id", "_version", F.lit(1).alias("_hit"), *(F.col(c).alias(f"_d_{c}") for c in ("review_decision", "reviewed_at_utc", "approved_by")))
    joined = _keyed(final).join(d, ["docket_id", "_version"], "left")
    hit = F.col("_hit") == 1
    changes = {"approved": F.lower("_d_review_decision") == "approved", "review_decision": F.col("_d_review_decision"), "reviewed_at_utc": F.col("_d_reviewed_at_utc"), "approved_by": F.col("_d_approved_by")}
    return joined.select(*(F.when(hit, F.coalesce(changes[c], F.lit(False)) if c == "approved" else changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in final.columns))


def retry(action: Callable[[], object], conflict: tuple[type[BaseException], ...] = (Conflict,), attempts: int = ATTEMPTS, delay: float = DELAY, sleep: Callable[[float], None] = time.sleep):
    """Run an action again after a conflict, waiting n times the delay before attempt n + 1."""
    for n in range(1, attempts + 1):
        try:
            return action()
        except conflict:
            if n == attempts:
                raise
            sleep(delay * n)


class VersionedTable:
    """A table with atomic commits on any Hadoop file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def current(self) -> int:
        """Number of the current version, 0 before the first."""
        folder = self._path(f"{self.path}/_commits")
        if not self._fs.exists(folder):
            return 0
        return max((int(s.getPath().getName()) for s in self._fs.listStatus(folder)), default=0)

    def read(self) -> DataFrame:
        n = self.current()
        if not n:
            raise ValueError(f"{self.path} has no version")
        stream = self._fs.open(self._path(f"{self.path}/_commits/{n:012d}"))
        try:
            name = stream.readUTF()
        finally:
            stream.close()
        return self.spark.read.parquet(f"{self.path}/{name}")

    def commit(self, df: DataFrame, expected: int) -> int:
        """Write a new version on top of ``expected``; ``Conflict`` if that is no longer the current one."""
        name = f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        n = expected + 1
        target = self._path(f"{self.path}/_commits/{n:012d}")
        try:
            out = self._fs.create(target, False)
        except Exception as problem:
            self._fs.delete(self._path(f"{self.path}/{name}"), True)
            raise Conflict(f"version {n} exists") from problem
        out.writeUTF(name)
        out.close()
        return n

    def change(self, function: Callable[[DataFrame], DataFrame]) -> int:
        """Read, change and commit, again after a conflict."""

        def once() -> int:
            n = self.current()
            return self.commit(function(self.read()), n)

        return retry(once)
