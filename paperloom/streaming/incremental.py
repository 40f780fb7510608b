"""Streaming forms: progress counts, batch flushing into versioned tables, skipping of seen keys, claim expiry."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from paperloom.operators.store import VersionedTable, upsert


def progress(stream: DataFrame, at: str, status: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts by status per time window, final once the watermark has passed."""
    return stream.withWatermark(at, late).groupBy(F.window(at, window).alias("window"), F.col(status).alias("status")).agg(F.count("*").alias("n"))


def unseen(stream: DataFrame, keys: list[str], at: str, late: str = "10 minutes") -> DataFrame:
    """Rows whose key has not come within the watermark."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def flush_into(stream: DataFrame, table: VersionedTable, prepare: Callable[[DataFrame], DataFrame] | None = None) -> DataStreamWriter:
    """Each micro-batch upserted into a versioned table; a repeated batch changes nothing."""

    def flush(batch: DataFrame, _: int) -> None:
        rows = prepare(batch) if prepare else batch
        table.change(lambda current: upsert(current, rows))

    return stream.writeStream.foreachBatch(flush)


def claim_expiry(claims: DataFrame, minutes: int = 45, late: str = "1 minute") -> DataFrame:
    """(docket_id, claim_token, outcome): a claim that is completed, released or, after ``minutes`` of event time without
    either, expired. ``claims`` has docket_id, claim_token, claim_status, at."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (token,) = state.get
            state.remove()
            yield pd.DataFrame({"docket_id": [key[0]], "claim_token": [token], "outcome": ["expired"]})
            return
        out = []
        rows = pd.concat(list(frames)).sort_values("at")
        for token, status, at in zip(rows["claim_token"], rows["claim_status"], rows["at"]):
            if status == "claimed":
                state.update((token,))
                end = int(at.timestamp() * 1000) + minutes * 60_000
                state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))
            elif state.exists:
                out.append((key[0], state.get[0], "completed" if status == "completed" else "released"))
                state.remove()
        yield pd.DataFrame(out, columns=["docket_id", "claim_token", "outcome"])

    keyed = claims.withWatermark("at", late).groupBy("docket_id")
    return keyed.applyInPandasWithState(run, "docket_id string, claim_token string, outcome string", "claim_token string", "append", GroupStateTimeout.EventTimeTimeout)
