"""Streams of updates from files, run to their end."""

import datetime as dt

import pytest

from fedloom.streaming import asynchronous as st

SCHEMA = "round int, client int, param string, idx int, value double, w double, ts timestamp"


@pytest.fixture()
def stream(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [(r, c, "p", 0, float(r + c), 1.0 + c, t + dt.timedelta(hours=r)) for r in range(6) for c in range(3)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in")
    return spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), spark.createDataFrame(rows, SCHEMA)


def ran(spark, df, mode, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_staleness_mean_equals_batch(spark, stream):
    live, batch = stream
    f = lambda x: st.staleness_mean(st.admit(x, 5, 3), ("param", "idx"))
    assert ran(spark, f(live), "complete", "stale").first()["value"] == pytest.approx(f(batch).first()["value"])


def test_windows_close(spark, stream):
    got = ran(spark, st.windowed_mean(stream[0], "2 hours", "1 hour"), "append", "windows")
    assert got.count() == 2 and {r["n"] for r in got.collect()} == {6}


def test_partial_round_by_count(spark, stream):
    rows = ran(spark, st.partial_rounds(stream[0], least=10), "append", "partial").collect()
    assert [(r["n"], r["reason"]) for r in rows] == [(18, "count")]


def test_partial_round_weighs_by_staleness(spark, stream):
    live, batch = stream
    rows = ran(spark, st.partial_rounds(live, least=3, current_round=5, most=3), "append", "late").collect()
    kept = [(r["value"], r["w"] * 0.99 ** (5 - r["round"])) for r in batch.collect() if 5 - r["round"] <= 3]
    assert [r["n"] for r in rows] == [len(kept)]
    assert rows[0]["value"] == pytest.approx(sum(v * w for v, w in kept) / sum(w for _, w in kept))


def test_pending_updates_are_those_of_open_rounds(spark, stream):
    _, batch = stream
    held = st.buffered(batch, 5, 3)
    none, one = spark.createDataFrame([], "param string, idx int"), spark.createDataFrame([("p", 0)], "param string, idx int")
    assert st.pending(held, none).count() == 12 and st.pending(held, one).count() == 0
