"""A stream's buffer of updates whose current round moves on, with state on the RocksDB store.

One log holds both kinds of messages in the order of seq: updates, and the rounds that the server opens. A buffer is a
block of WIDTH coordinates of one parameter of a group; a round's message is dealt to all blocks of its group, which a
static table names. Updates get their staleness from the round that is current when they arrive and keep it. A buffer
is released as soon as `least` updates wait, or wait_ms after the first of them came, by a processing-time timer.

Within a micro-batch a buffer's messages are taken in the order of seq, so releases by count don't depend on where
micro-batches end. State is the waiting updates of a block, in entries of HELD rows, and they are gone when it is
released. All of a buffer's messages in a micro-batch are weighed, numbered and summed as arrays, never one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..plans.session import ship_package

WIDTH = 4096
KEY = ("grp", "param", "block")
OUT = "grp bigint, param string, block bigint, release bigint, idx int, value double, n bigint, reason string"
_ITEM = "data binary"
HELD = 1 << 15  # waiting rows of an entry of the state
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Streams started within it have these settings (with _ for a dot)."""
    names = {k.replace("_", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def rocksdb_state(spark: SparkSession):
    """Streams started within it keep their state on the RocksDB store."""
    return settings(spark, spark_sql_streaming_stateStore_providerClass=ROCKS)


def stale(weight: np.ndarray, staleness: np.ndarray, method: str, base: float, most: int, threshold: int = 5) -> np.ndarray:
    """As functions.columns.staleness_weight, for arrays."""
    if method == "decay":
        return weight * np.power(base, staleness.astype(np.float64))
    if method == "linear":
        return weight * np.maximum(0.0, 1 - staleness / most)
    if method == "quadratic":
        return weight * np.maximum(0.0, 1 - (staleness / most) ** 2)
    if method == "threshold":
        return np.where(staleness <= threshold, weight, weight * np.power(base, (staleness - threshold).astype(np.float64)))
    return weight


#: A row that waits.
_ROW = np.dtype([("idx", "<i4"), ("value", "<f8"), ("w", "<f8")])


class Buffer(StatefulProcessor):
    """The waiting updates of one block."""

    def __init__(self, least: int, wait_ms: int | None, most: int, method: str, base: float, width: int):
        self.least, self.wait_ms, self.most, self.method, self.base, self.width = max(1, least), wait_ms, most, method, base, width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _ITEM)
        #: The current round, updates waiting, releases so far, and the timer that is set, 0 if none is.
        self.head = handle.getValueState("head", "current bigint, n bigint, released bigint, timer bigint")

    def _waiting(self) -> Iterator[np.ndarray]:
        """Rows that wait, some at a time."""
        for item in self.waiting.get():
            yield np.frombuffer(item[0], _ROW)

    def _release(self, key: tuple, parts: Iterator[tuple[np.ndarray, np.ndarray]], first: int, n: np.ndarray, reason: str) -> Iterator[pd.DataFrame]:
        """Weighted means by coordinate of the releases first, first + 1 and so on, of n updates each, from pieces of (release less first, rows)."""
        sums = None
        for release, x in parts:
            release, x = release[there := ~np.isnan(x["value"])], x[there]
            at = release * self.width + x["idx"] % self.width
            places, at = np.unique(at, return_inverse=True)
            new = pd.DataFrame({"vw": np.bincount(at, x["value"] * x["w"], len(places)), "w": np.bincount(at, x["w"], len(places)), "idx": 0}, index=places)
            new.loc[:, "idx"] = x["idx"][np.unique(at, return_index=True)[1]] if len(x) else 0
            sums = new if sums is None else pd.concat([sums, new]).groupby(level=0).agg({"vw": "sum", "w": "sum", "idx": "first"})
        if sums is None:
            return
        release = (sums.index.to_numpy() // self.width).astype(np.int64)
        w = sums["w"].to_numpy()
        value = np.divide(sums["vw"].to_numpy(), w, out=np.full(len(w), np.nan), where=w != 0)
        out = pd.DataFrame({"release": first + release, "idx": sums["idx"].to_numpy().astype(np.int32), "value": pd.array(value, dtype="Float64"), "n": n[release]})
        out.loc[w == 0, "value"] = pd.NA
        out = out.assign(reason=reason, **dict(zip(KEY, key, strict=True)))[[*KEY, "release", "idx", "value", "n", "reason"]]
        for lo in range(0, len(out), HELD):
            yield out.iloc[lo : lo + HELD]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        current, n, released, timer = self.head.get() if self.head.exists() else (None, 0, 0, 0)
        # numbers only, of all the key's messages in this micro-batch
        names = {"seq": np.int64, "opens": bool, "round": np.int64, "idx": np.int32, "value": np.float64, "w": np.float64}
        parts = []
        for x in rows:
            opens = x["kind"] == "round"
            # only a round's message has no coordinate
            x = x.assign(opens=opens, round=x["round"].astype(np.int64), idx=x["idx"].mask(opens, 0).astype(np.int32), w=x["w"].fillna(0.0))[opens | (x["kind"] == "update")]
            parts.append([x[c].to_numpy(kind) for c, kind in names.items()])
        seq, opens, round_, idx, value, w = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.argsort(seq, kind="stable")
        seq, opens, round_, idx, value, w = (c[order] for c in (seq, opens, round_, idx, value, w))
        # the round that is current at each seq: the greatest one that it, or else the last seq before it, opens
        _, begins, message = np.unique(seq, return_index=True, return_inverse=True)
        low = np.iinfo(np.int64).min
        now = np.maximum.reduceat(np.where(opens, round_, low), begins) if len(begins) else np.zeros(0, np.int64)
        last = np.maximum.accumulate(np.where(now > low, np.arange(len(now)), -1))
        known = np.where(last >= 0, now[last], low if current is None else current)
        current = int(known[-1]) if len(known) and known[-1] > low else current
        updates = np.flatnonzero(~opens)
        message, round_ = message[updates], round_[updates]
        # before any round is known, an update's first row stands for it
        first = round_[np.unique(message, return_index=True)[1]] if len(updates) else round_
        own = first[np.unique(message, return_inverse=True)[1]] if len(updates) else first
        lag = np.where(known[message] > low, known[message], own) - round_
        updates, message, lag = updates[kept := lag <= self.most], message[kept], lag[kept]
        items = np.empty(len(updates), _ROW)
        items["idx"], items["value"] = idx[updates], value[updates]
        items["w"] = stale(w[updates], lag, self.method, self.base, self.most)
        new, number = np.unique(message, return_inverse=True)
        number = number + n  # of each row's update among those that wait and come
        whole, n_before = (n + len(new)) // self.least, n
        if whole:
            done = number < whole * self.least

            def parts_of() -> Iterator[tuple[np.ndarray, np.ndarray]]:
                if n_before:
                    yield from ((np.zeros(len(x), np.int64), x) for x in self._waiting())
                yield number[done] // self.least, items[done]

            yield from self._release(key, parts_of(), released, np.full(whole, self.least, np.int64), "count")
            if n_before:
                self.waiting.clear()
            if timer:
                self.handle.deleteTimer(timer)
            items, released, timer = items[~done], released + whole, 0
        n = n + len(new) - whole * self.least
        if len(items):
            self.waiting.appendList([(items[lo : lo + HELD].tobytes(),) for lo in range(0, len(items), HELD)])
        if n and not timer and self.wait_ms is not None:
            timer = timerValues.getCurrentProcessingTimeInMs() + self.wait_ms
            self.handle.registerTimer(timer)
        self.head.update((current, n, released, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        current, n, released, _ = self.head.get()
        if n:
            yield from self._release(key, ((np.zeros(len(x), np.int64), x) for x in self._waiting()), released, np.array([n], np.int64), "time")
            self.waiting.clear()
            released += 1
        self.head.update((current, 0, released, 0))

    def close(self) -> None:
        pass


def blocks_of(catalog: DataFrame, width: int = WIDTH) -> DataFrame:
    """(grp, param, block) of a catalogue of coordinates (grp, param, idx)."""
    return catalog.select("grp", "param", F.floor(F.col("idx") / width).cast("bigint").alias("block")).distinct()


def moving_rounds(
    log: DataFrame, blocks: DataFrame, least: int = 3, wait_ms: int | None = 60_000, most: int = 10, method: str = "decay", base: float = 0.99, width: int = WIDTH
) -> DataFrame:
    """(grp, param, block, release, idx, value, n, reason) of a stream (seq, kind, grp, round, param, idx, value, w).

    kind is "update", or "round" for a server's new current round, whose parameter, coordinate and value aren't looked at.
    An update is all rows of one seq within a block; the weighted mean of those that wait is released by coordinate, n
    counts updates. Updates over `most` rounds old when they arrive are dropped, those of later rounds weigh more than
    1, as their staleness is below 0. Before any round is known, updates aren't late. Null values weigh nothing. Needs
    the RocksDB store (rocksdb_state) while the stream starts.
    """
    ship_package(log.sparkSession)
    updates = log.where("kind = 'update'").withColumn("block", F.floor(F.col("idx") / width).cast("bigint"))
    rounds = log.where("kind = 'round'").select("seq", "kind", "grp", "round").join(F.broadcast(blocks) if not blocks.isStreaming else blocks, "grp")
    cols = [F.col("grp").cast("bigint").alias("grp"), "param", "block", "seq", "kind", F.col("round").cast("bigint").alias("round"), F.col("idx").cast("int").alias("idx"), "value", "w"]
    none = [F.lit(None).cast("int").alias("idx"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("double").alias("w")]
    both = updates.select(*cols).unionByName(rounds.select("grp", "param", "block", "seq", "kind", "round", *none).select(*cols))
    return both.groupBy(*KEY).transformWithStateInPandas(Buffer(least, wait_ms, most, method, base, width), OUT, "append", "processingTime")


def run_to_end(stream: DataFrame, checkpoint: str, path: str) -> None:
    """All that is there now, micro-batch by micro-batch, appended to a Parquet folder exactly once, as the sink's log says.

    With processing-time timers a stream never has nothing more to do, so it ends with the data: a timer that is due
    fires in the next micro-batch that has some, behind that one's messages. Run again with the same checkpoint, it
    goes on where it ended or broke off.
    """
    with rocksdb_state(stream.sparkSession), settings(stream.sparkSession, spark_sql_streaming_noDataMicroBatches_enabled="false"):
        query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", path).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
