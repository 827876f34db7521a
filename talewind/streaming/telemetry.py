"""Streaming forms: gap sessions with late data, running entity statistics, exactly-once batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def gap_sessions(events: DataFrame, key: str, ts: str = "ts", gap_s: int = 300, late: str = "1 day") -> DataFrame:
    """Closed sessions per key of a stream; one is emitted when the watermark has passed its gap.

    Built-in session windows end ``gap_s`` after the last event, so two events exactly that far apart share one.
    """
    w = F.session_window(ts, f"{gap_s} seconds")
    return events.withWatermark(ts, late).groupBy(w, key).agg(F.count("*").alias("n_events"), F.min(ts).alias("start"), F.max(ts).alias("end")).drop("session_window")


def running_scores(events: DataFrame, entity: str, value: str) -> DataFrame:
    """``(entity, n, value, z)`` of a stream: each value against the entity's earlier ones (Welford), state per entity.

    Rows of one trigger are taken in the order they arrive in; a null value counts as 0.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, mean, m2 = state.get if state.exists else (0, 0.0, 0.0)
        for pdf in frames:
            out = []
            for x in pdf[value].fillna(0.0):
                sd = (m2 / (n - 1)) ** 0.5 if n > 1 else 0.0
                out.append((key[0], n, float(x), (x - mean) / sd if sd > 0 else 0.0))
                n += 1
                d = x - mean
                mean += d / n
                m2 += d * (x - mean)
            yield pd.DataFrame(out, columns=["entity", "n", "value", "z"])
        state.update((n, float(mean), float(m2)))

    typed = events.select(F.col(entity).cast("string").alias(entity), F.col(value).cast("double").alias(value))
    return typed.groupBy(entity).applyInPandasWithState(step, "entity string, n long, value double, z double", "n long, mean double, m2 double", "append", GroupStateTimeout.NoTimeout)


def each_batch(stream: DataFrame, take: Callable[[DataFrame, int], object], checkpoint: str):
    """Run ``take(rows, batch number)`` on every micro-batch.

    A batch may be run again after a failure.  The stores leave out a batch number they have taken in, so
    ``take=store.ingest`` makes every batch count exactly once.
    """
    return stream.writeStream.foreachBatch(lambda df, i: (take(df, i), None)[1]).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
