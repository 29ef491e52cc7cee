"""Asynchronous aggregation over streams of updates.

Streams have (round, client, param, idx, value, w, ts). All functions also take batch frames, for which the
staleness and weights are alike; state is used only where a count or a time decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.columns import present, ratio, staleness_weight


def admit(stream: DataFrame, current_round: int, most: int = 10) -> DataFrame:
    """Updates at most so many rounds old, with their staleness as on arrival."""
    return stream.withColumn("staleness", F.lit(current_round) - F.col("round")).where(F.col("staleness") <= most)


def staleness_mean(updates: DataFrame, by: tuple[str, ...], method: str = "decay", base: float = 0.99) -> DataFrame:
    """Weighted mean of present values in which late updates weigh less; on a stream with output mode complete or update."""
    w = present("value", staleness_weight(F.col("w"), F.col("staleness"), method, base))
    return updates.groupBy(*by).agg(ratio(F.sum(F.col("value") * w), F.sum(w)).alias("value"))


def windowed_mean(stream: DataFrame, width: str, late: str) -> DataFrame:
    """Means of event-time windows, for streams whose rounds are stretches of time."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    g = timed.groupBy(F.window("ts", width), "param", "idx").agg(ratio(F.sum(F.col("value") * F.col("w")), F.sum(present("value", "w"))).alias("value"), F.count("*").alias("n"))
    return g.select(F.col("window.start").alias("start"), "param", "idx", "value", "n")


def buffered(stream: DataFrame, current_round: int, most: int = 10, method: str = "decay", base: float = 0.99) -> DataFrame:
    """Admitted updates, weighing less the later they are: their staleness is fixed on arrival."""
    return admit(stream, current_round, most).withColumn("w", staleness_weight(F.col("w"), F.col("staleness"), method, base))


def pending(updates: DataFrame, released: DataFrame, keys: tuple[str, ...] = ("param", "idx")) -> DataFrame:
    """Admitted updates of coordinates that no partial round has released yet."""
    return updates.join(released.select(*keys), list(keys), "left_anti")


def partial_rounds(stream: DataFrame, least: int = 3, wait_ms: int = 60_000, current_round: int | None = None, most: int = 10, method: str = "decay", base: float = 0.99) -> DataFrame:
    """(param, idx, value, n, reason): a coordinate's mean as soon as `least` updates came or wait_ms passed since the first.

    With a current round, updates over `most` rounds old are dropped and the others weigh by their staleness (buffered).
    The state of a coordinate is three numbers (weighted sum, weights, count), whatever the number of updates.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            total, w, n = state.get
            state.remove()
            if n:
                yield pd.DataFrame([(*key, total / w if w else None, n, "time")], columns=["param", "idx", "value", "n", "reason"])
            return
        total, w, n = state.get if state.exists else (0.0, 0.0, 0)
        fresh = n == 0
        for f in frames:
            total += float((f["value"] * f["w"]).sum())
            w += float(f["w"].sum())
            n += len(f)
        if n >= least:
            state.remove() if state.exists else None
            yield pd.DataFrame([(*key, total / w if w else None, n, "count")], columns=["param", "idx", "value", "n", "reason"])
            return
        state.update((total, w, n))
        if fresh:
            state.setTimeoutDuration(wait_ms)

    if current_round is not None:
        stream = buffered(stream, current_round, most, method, base)
    return stream.groupBy("param", "idx").applyInPandasWithState(
        step, "param string, idx int, value double, n bigint, reason string", "total double, w double, n bigint", "append", GroupStateTimeout.ProcessingTimeTimeout
    )
