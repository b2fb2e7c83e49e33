"""The adaptive crawl loop as Structured Streaming: state by site, failures by URL, and upserts by micro-batch."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siltstone.operators.frontier import failures, next_phase

PHASE_OUT = "site string, at long, phase string, processed long, new long"
_PHASE_STATE = "phase string, processed long, new long, since double"


def phase_stream(steps: DataFrame) -> DataFrame:
    """Phases of each site over a stream of steps (site, at, processed, new, minutes): one row for every step, in order within a batch."""

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        phase, processed, new, since = state.get if state.exists else ("initial", 0, 0, 0.0)
        rows: list[tuple[Any, ...]] = []
        got = sorted((r for b in batches for r in zip(b["at"], b["processed"], b["new"], b["minutes"], strict=True)), key=lambda r: r[0])
        for at, p, n, minutes in got:
            processed, new = processed + int(p), new + int(n)
            after = next_phase(phase, processed, new, float(minutes) - since)
            if after != phase:
                phase, processed, new, since = after, 0, 0, float(minutes)
            rows.append((key[0], int(at), phase, processed, new))
        state.update((phase, processed, new, since))
        yield pd.DataFrame(rows, columns=["site", "at", "phase", "processed", "new"])

    return steps.groupBy("site").applyInPandasWithState(advance, PHASE_OUT, _PHASE_STATE, "append", GroupStateTimeout.NoTimeout)


def failure_stream(events: DataFrame) -> DataFrame:
    """Attempts by URL over a stream (url, ts, error), in update mode."""
    return failures(events)


def windowed_counts(events: DataFrame, ts: str = "ts", key: str = "event_type", length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by time window and key, dropping what comes later than ``late``."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, length), key).agg(F.count("*").alias("n"))


def upsert_stream(batches: DataFrame, store_path: str, checkpoint: str):
    """Upserts every micro-batch of (url, title, content, content_type, meta_data, arrival) into the Parquet store at ``store_path``.

    A batch writes a new version of the store and then points to it, so that a batch that runs
    again replaces its own version. Returns the started query.
    """
    from siltstone.functions.text import similarity_hash
    from siltstone.operators.store import apply_upsert, upsert_outcomes

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        store = read_store(spark, store_path, number - 1)
        hashed = batch.withColumn("similarity_hash", similarity_hash(F.col("content")))
        outcomes = upsert_outcomes(hashed, store)
        apply_upsert(outcomes, store).write.mode("overwrite").parquet(f"{store_path}/v={number}")

    return batches.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_store(spark: SparkSession, path: str, number: int) -> DataFrame:
    """The store after batch ``number``; empty before the first."""
    from siltstone.sources.schemas import empty

    return spark.read.parquet(f"{path}/v={number}") if number >= 0 else empty(spark, "content_items").select("id", "url", "title", "content", "content_type", "meta_data", "similarity_hash", "view_count", "status")
