"""The merge policies on streams: current values kept in state, late rows welcome, and micro-batch loops."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def newest_wins(stream: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """(key, value, ts) after every batch that changed them: the value with the greatest time, the first arrival on ties.

    Older rows never replace newer ones, however late they come, so no watermark is needed and the state holds one
    value a key. Rows of one batch are taken in the order of time, then of value; blank values are ignored. The rows of
    a key in a batch are reduced before they reach the state.
    """
    best = stream.where(F.col(key).isNotNull() & F.col(ts).isNotNull() & F.col(value).isNotNull() & (F.trim(value) != "")).select(key, ts, value)
    kinds = {c: best.schema[c].dataType.simpleString() for c in (key, ts, value)}
    out = f"{key} {kinds[key]}, {value} {kinds[value]}, {ts} {kinds[ts]}"

    def update(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held: tuple[Any, ...] | None = state.get if state.exists else None
        start = held
        for batch in batches:
            top = batch.sort_values([ts, value], ascending=[False, True]).iloc[0]
            if held is None or top[ts] > held[0]:
                held = (top[ts], top[value])
        if held is not None and held != start:
            state.update(held)
            yield pd.DataFrame({key: [group[0]], value: [held[1]], ts: [held[0]]})

    return best.groupBy(key).applyInPandasWithState(update, out, f"{ts} {kinds[ts]}, {value} {kinds[value]}", "update", GroupStateTimeout.NoTimeout)


def enqueue(stream: DataFrame, key: str) -> DataFrame:
    """Rows with a key that the stream hasn't had before."""
    return stream.dropDuplicates([key])


def windowed_counts(stream: DataFrame, at: str, size: str, late: str, *groups: str) -> DataFrame:
    """Rows by window and group; rows later than ``late`` behind the newest are left out."""
    timed = stream.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    return timed.groupBy(F.window("_at", size).alias("w"), *groups).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), *groups, "n")


def drain(stream: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> None:
    """Writes all that is there as Parquet and stops; the next call goes on where this one ended."""
    stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
