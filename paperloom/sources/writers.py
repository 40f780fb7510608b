"""Writers: Parquet and tables by mode, page exports with manifests, index tables, summaries."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MODES = ("overwrite", "errorifexists", "ignore", "append")


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists", skip: bool = False) -> bool:
    """Write unless ``skip``; says whether it wrote."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    if not skip:
        df.write.mode(mode).parquet(path)
    return not skip


def write_table(df: DataFrame, name: str, dry_run: bool = False) -> bool:
    """Replace a managed table, in Parquet; a dry run only checks the plan."""
    if dry_run:
        df.schema  # noqa: B018
        return False
    df.write.mode("overwrite").format("parquet").saveAsTable(name)
    return True


def create_table(spark: SparkSession, name: str, ddl: str) -> None:
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({ddl}) USING parquet")


def write_exports(exports: DataFrame, path: str, manifest: DataFrame | None = None, mode: str = "append") -> None:
    """JSON documents below one folder per docket, the manifest as JSON lines and CSV beside them."""
    exports.write.mode(mode).partitionBy("docket_id").json(f"{path}/documents")
    if manifest is not None:
        manifest.write.mode(mode).json(f"{path}/manifest_jsonl")
        manifest.write.mode(mode).option("header", True).csv(f"{path}/manifest_csv")


def upsert_index(index: DataFrame | None, chunks: DataFrame, order: str) -> DataFrame:
    """Index rows with the chunks merged in by chunk_id; of several chunks with one id the last in ``order`` stays."""
    from paperloom.operators.selection import latest

    new = latest(chunks, ["chunk_id"], [F.col(order).desc_nulls_last()])
    return new if index is None else index.join(new.select("chunk_id"), "chunk_id", "left_anti").unionByName(new, allowMissingColumns=True)


def summary_json(row: DataFrame) -> str:
    """A one-row frame as JSON text."""
    first = row.first()
    return json.dumps(first.asDict(recursive=True) if first else {}, default=str, ensure_ascii=False, sort_keys=True)
