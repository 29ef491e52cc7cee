"""Operators for models, histories and logs that don't fit a row or a task, against numpy and by definition."""

import itertools
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from fedloom.operators import aggregate as agg
from fedloom.operators import coding, distances, scan, selection, transforms
from fedloom.operators import privacy as dp
from fedloom.operators import robust as byz
from fedloom.operators import secure as sec
from fedloom.operators import state as st
from fedloom.plans.session import new_path
from fedloom.sources import raw
from fedloom.sources.client_state import ClientState
from fedloom.streaming import moving

SCHEMA = "grp int, client string, param string, idx int, value double, w double, steps int"


# -- absent and repeated values


def test_absent_values_count_nowhere(spark):
    u = spark.createDataFrame([(0, c, "p", 0, v, 1.0, 1) for c, v in zip("abcd", (None, 1.0, 2.0, 3.0), strict=True)], SCHEMA)
    one = lambda df: df.first()["value"]
    assert one(agg.weighted_mean(u)) == one(agg.minibatch_mean(u)) == one(agg.trimmed_mean(u)) == 2.0
    assert one(agg.hierarchical_mean(u.withColumn("c", F.col("client") < "c"), "c")) == pytest.approx((1 + 2.5) / 2)
    none = u.withColumn("value", F.lit(None).cast("double"))
    assert [one(f(none)) for f in (agg.weighted_mean, agg.trimmed_mean, agg.minibatch_mean)] == [None, None, None]
    assert byz.pairwise_distance(none).count() == 0 and byz.krum_survivors(none).count() == 0


def test_the_last_row_of_a_coordinate_counts(spark):
    rows = [(0, "a", "p", 0, 5.0, 1.0, 1), (0, "a", "p", 0, 1.0, 1.0, 2), (0, "b", "p", 0, 2.0, 1.0, 1)]
    u = spark.createDataFrame(rows, SCHEMA)
    assert byz.pairwise_distance(u).first()["dist"] == 3.0
    assert byz.pairwise_distance(u, order="steps").first()["dist"] == 1.0
    assert agg.last_rows(u, "steps").where("client = 'a'").first()["value"] == 1.0


def test_distances_over_tiles_and_blocks(spark):
    rng = np.random.default_rng(4)
    rows = [(g, f"c{c}", p, i, float(rng.normal() * 1e6), 1.0, 1) for g in range(2) for c in range(11) for p in "ab" if rng.random() < 0.9 for i in range(9) if rng.random() < 0.9]
    of = {}
    for g, c, p, i, v, *_ in rows:
        of.setdefault((g, c), {})[p, i] = v
    want = {(g, a, b): math.dist([of[g, a][k] for k in sorted(s)], [of[g, b][k] for k in sorted(s)]) for g, a in of for h, b in of if g == h and a < b and (s := of[g, a].keys() & of[g, b].keys())}
    found = distances.pair_sums(spark.createDataFrame(rows, SCHEMA), tile=3, width=4).collect()
    assert {(r["grp"], r["a"], r["b"]): math.sqrt(r["total"]) for r in found} == pytest.approx(want)
    assert {(r["grp"], r["a"], r["b"]): r["shared"] for r in found} == {(g, a, b): len(of[g, a].keys() & of[g, b].keys()) for g, a, b in want}


def test_equal_clients_far_from_0_have_distance_0(spark):
    rows = [(0, c, "p", i, 1e9 + i / 3, 1.0, 1) for c in "ab" for i in range(50)]
    assert byz.pairwise_distance(spark.createDataFrame(rows, SCHEMA)).first()["dist"] == 0.0


def test_pairs_of_clients_are_never_shuffled(spark):
    rng = np.random.default_rng(8)
    rows = [(g, c, p, i, float(rng.normal()), 1.0, 1) for g in range(2) for c in range(14) for p in "ab" if rng.random() < 0.7 for i in range(5)]
    rows += [(0, 20 + c, p, i, v, 1.0, 1) for g, c, p, i, v, *_ in rows if g == 0 and c < 3]
    u = spark.createDataFrame(rows, SCHEMA.replace("client string", "client int"))
    plan = distances.pair_sums(u, tile=4)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("InArrow")]
    of = {}
    for g, c, p, i, v, *_ in rows:
        of.setdefault((g, c), {})[p, i] = v
    for faulty in (0, 1, 3, 11):
        want = {}
        for g, a in of:
            n, k = (x := sum(h == g for h, _ in of)), x - 2 - faulty
            d = sorted(math.dist([of[g, a][k] for k in s], [of[g, b][k] for k in s]) for h, b in of if h == g and b != a and (s := of[g, a].keys() & of[g, b].keys()))
            if d:
                want[g, a] = (n, k, sum(d[: max(k, 0)]))
        parts = distances.far_sums(u, faulty + 1, tile=4)
        assert parts.count() <= sum(-(-sum(h == g for h, _ in of) // 4) for g, _ in of) and parts.select(F.max(F.size("far"))).first()[0] <= faulty + 1
        got = {(r["grp"], r["client"]): (r["n"], r["k"], r["score"]) for r in byz.krum_scores(u, faulty).collect()}
        assert got.keys() == want.keys()
        for key, x in want.items():
            assert got[key] == pytest.approx(x)
        # equal clients have equal scores
        assert all(got[0, c][2] == got[0, 20 + c][2] for c in range(3) if (0, c) in got)


def test_what_distances_shuffle_grows_as_the_clients(spark):
    rng = np.random.default_rng(3)
    rows = [(0, f"c{c}", p, i, v, 1.0, 1) for c in range(40) for p in "ab" if rng.random() < 0.8 for i in range(0, 9, 2) if rng.random() < 0.9 for v in (float(rng.normal()), 0.5)]
    u = spark.createDataFrame([r for k, r in enumerate(rows) if k % 2 == 0 or r[4] != 0.5], SCHEMA)
    of = {}
    for _, c, p, i, v, *_ in u.collect():
        of.setdefault(c, {})[p, i] = v
    want = {(a, b): math.dist([of[a][k] for k in sorted(s)], [of[b][k] for k in sorted(s)]) for a in of for b in of if a < b and (s := of[a].keys() & of[b].keys())}
    parts = distances.far_sums(u, 2, tile=1)
    # forty tiles, of which each has met all others
    assert parts.groupBy("client").count().agg(F.max("count")).first()[0] <= distances.PARTS
    met = {c: sum(c in k for k in want) for c in of}
    assert {r["client"]: r["m"] for r in parts.groupBy("client").agg(F.sum("m").alias("m")).collect()} == met
    for tile in (1, 7):
        found = distances.pair_sums(u, tile=tile, width=4).collect()
        assert {(r["a"], r["b"]): math.sqrt(r["total"]) for r in found} == pytest.approx(want)


def _krum(rows, faulty, multi):
    """Survivors by definition, from (grp, client, param, idx, value)."""
    of = {}
    for g, c, p, i, v, *_ in rows:
        of.setdefault((g, c), {})[p, i] = v
    out = set()
    for g in {g for g, _ in of}:
        mine = {c: x for (h, c), x in of.items() if h == g}
        far = {c: sorted(math.dist([x[k] for k in s], [y[k] for k in s]) for b, y in mine.items() if b != c and (s := sorted(x.keys() & y.keys()))) for c, x in mine.items()}
        k, most = len(mine) - 2 - faulty, len(mine) - faulty - 1 if multi else 1
        met = sorted((math.fsum(d[: max(k, 0)]), c) for c, d in far.items() if d)
        out |= {(g, c) for _, c in (met if k < 1 else met[:most])} | ({(g, c) for c in mine} if len(mine) == 1 else set())
    return out


def _clients(rng, n, spread=1.0, offset=0.0):
    rows = [(g, c, p, i, float(offset + spread * rng.normal()), 1.0, 1) for g in range(2) for c in range(n) for p in "abc" if rng.random() < 0.7 for i in range(4) if rng.random() < 0.95]
    return rows + [(0, n + c, p, i, v, 1.0, 1) for g, c, p, i, v, *_ in rows if g == 0 and c < 5]


INT_CLIENTS = SCHEMA.replace("client string", "client int")


@pytest.mark.parametrize(("spread", "offset"), [(1.0, 0.0), (1e-3, 1e9), (1e-140, 0.0), (1e60, 1e60)])
def test_bounds_hold_the_sums_of_distances(spark, spread, offset):
    rows = _clients(np.random.default_rng(13), 23, spread, offset)
    u = spark.createDataFrame(rows, INT_CLIENTS)
    exact = {(r["grp"], r["client"]): (r["m"], r["s"]) for r in distances.far_sums(u, 0, tile=5).groupBy("grp", "client").agg(F.sum("m").alias("m"), F.sum(F.col("high") + F.col("low")).alias("s")).collect()}
    found = distances.bound_sums(distances.gathered(u), tile=5).groupBy("grp", "client").agg(F.sum("m").alias("m"), F.sum("low").alias("low"), F.sum("high").alias("high")).where("m > 0").collect()
    assert {(r["grp"], r["client"]): r["m"] for r in found} == {k: m for k, (m, _) in exact.items()}
    for r in found:
        s = exact[r["grp"], r["client"]][1]
        assert r["low"] <= s * (1 + 1e-12) and r["high"] >= s * (1 - 1e-12)
        # clients share few coordinates and some none, so bounds are some thousandths apart
        assert spread == 1e-140 or r["high"] - r["low"] < 0.05 * s


def test_krum_takes_distances_of_few_clients(spark, monkeypatch):
    asked, scores = [], byz._scores
    monkeypatch.setattr(byz, "_scores", lambda *args: asked.append(args[3].count()) or scores(*args))
    rng = np.random.default_rng(2)
    rows = [(0, c, "p", i, float(rng.normal() * (3 if c % 50 == 0 else 1)), 1.0, 1) for c in range(600) for i in range(3)]
    u = spark.createDataFrame(rows, INT_CLIENTS)
    for multi in (True, False):
        asked.clear()
        assert {(r["grp"], r["client"]) for r in byz.krum_survivors(u, 1, multi).collect()} == _krum(rows, 1, multi)
        assert sum(asked) < 60


@pytest.mark.parametrize("faulty", [0, 1, 5, 30])
def test_krum_by_bounds_keeps_who_is_near_by_definition(spark, faulty):
    rows = _clients(np.random.default_rng(faulty), 28)
    # ties of all clients, a group of one, a client that shares nothing
    rows += [(2, c, "a", 0, 7.0, 1.0, 1) for c in range(9)] + [(3, 1, "a", 0, 1.0, 1.0, 1), (1, 99, "z", 0, 1.0, 1.0, 1)]
    u = spark.createDataFrame(rows, INT_CLIENTS)
    for multi in (True, False):
        assert {(r["grp"], r["client"]) for r in byz.krum_survivors(u, faulty, multi).collect()} == _krum(rows, faulty, multi)


def test_krum_of_values_too_large_for_bounds(spark):
    rows = [(0, c, "p", i, float((c % 7) * 10.0 ** (c % 3) + i) * 1e151, 1.0, 1) for c in range(12) for i in range(2)]
    got = {(r["grp"], r["client"]) for r in byz.krum_survivors(spark.createDataFrame(rows, INT_CLIENTS)).collect()}
    assert got == _krum(rows, 1, True)


def test_blocks_have_no_null_lists(spark):
    rows = [(0, c, "p", i, v, 1.0, 1) for c in range(4) for i in range(0, 9, 1 + c % 2) for v in (0.5 if c < 2 else 1 / 3,)]
    found = distances.gathered(spark.createDataFrame(rows, INT_CLIENTS))
    # Spark looks at a batch's size after each row, and for lists that are null so far it goes through all rows again
    assert found.where("i IS NULL OR f IS NULL OR d IS NULL").count() == 0 and found.where("size(f) + size(d) > 0").count() == 4


def test_a_cell_reads_blocks_from_a_file(monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(30, 20))
    found = []
    for held in (1 << 20, 100):
        monkeypatch.setattr(distances, "HELD", held)
        cell = distances.Cell(True)
        for t in range(3):
            for k in range(2):
                cell.add(True, t, ("p", k), list(range(10 * t, 10 * t + 10)), np.arange(10), x[10 * t : 10 * t + 10, 10 * k : 10 * k + 10])
        assert (cell.file is None) == (held > 100)
        found.append({(a, b): total for a, b, total, _ in cell.pairs()})
    assert found[0].keys() == found[1].keys() == {(a, b) for a in range(3) for b in range(a, 3)}
    for (a, b), total in found[0].items():
        assert (total == found[1][a, b]).all()
        want = ((x[10 * a : 10 * a + 10, None] - x[None, 10 * b : 10 * b + 10]) ** 2).sum(2)
        assert (np.triu(total, 1) if a == b else total) == pytest.approx(np.triu(want, 1) if a == b else want)


# -- selection


@pytest.mark.parametrize("share", [0.0, 0.1, 0.5, 0.77, 1.0])
def test_percentiles_by_numpy(spark, share):
    rng = np.random.default_rng(2)
    groups = {1: rng.normal(size=501) * 10.0 ** rng.integers(-200, 200, 501), 2: np.repeat([1.0, -0.0, 0.0, 2.0], 40), 3: np.array([5.0]), 4: -np.abs(rng.normal(size=30)), 5: np.array([-np.inf, 1.0, np.inf, 1.0, 2.0])}
    rows = [(g, float(v)) for g, x in groups.items() for v in x] + [(1, None), (6, None)]
    got = {r["g"]: r["value"] for r in selection.percentiles(spark.createDataFrame(rows, "g int, value double"), ["g"], share).collect()}
    assert set(got) == {1, 2, 3, 4, 5}
    for g, x in groups.items():
        want = np.sort(x)
        place = share * (len(x) - 1)
        lo, hi = want[math.floor(place)], want[math.ceil(place)]
        part = place - math.floor(place)
        assert got[g] == pytest.approx(lo if lo == hi else lo * (1 - part) + hi * part, rel=1e-12)


def test_kth_largest_of_a_hot_group(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=3000).astype(np.float64)
    df = spark.createDataFrame([(0, float(v)) for v in x] + [(1, 1.0), (1, float("nan"))], "g int, value double")
    got = {r["g"]: r["value"] for r in selection.kth_largest(df, ["g"], F.lit(100)).collect()}
    assert got == {0: np.sort(x)[-100]}
    first = {r["g"]: r["value"] for r in selection.kth_largest(df, ["g"], F.lit(1)).collect()}
    assert first[0] == x.max() and math.isnan(first[1])


def test_bits_keep_the_order():
    x = np.array([-np.inf, -1e300, -1.0, -5e-324, 0.0, 5e-324, 1.0, 1e300, np.inf, np.nan])
    import pyarrow as pa

    bits = selection._order_bits(pa.array(x)).to_numpy().view(np.uint64)
    assert (np.diff(bits.astype(object)) > 0).all()
    assert np.array_equal(selection._from_order_bits(pa.array(bits.view(np.int64))).to_numpy(), x, equal_nan=True)
    assert selection._order_bits(pa.array([-0.0])) == selection._order_bits(pa.array([0.0]))


# -- scans


@pytest.mark.parametrize("factor,length", [(0.9, None), (0.99, 7), (0.0, 5), (1.0, 3), (0.5, 1)])
def test_linear_scan_by_definition(spark, factor, length):
    rng = np.random.default_rng(1)
    rows = [(k, int(t) * 3 - 50, float(rng.normal())) for k in range(3) for t in rng.choice(200, 60, replace=False)]
    df = spark.createDataFrame(rows, "k int, round bigint, b double")
    got = {(r["k"], r["round"]): (r["_t"], r["y"]) for r in scan.linear_scan(df, ["k"], {"y": (factor, F.col("b"))}, length=length).collect()}
    for k in range(3):
        y = 0.0
        for t, (_, r, v) in enumerate(sorted(x for x in rows if x[0] == k), 1):
            y = factor * y + v
            assert got[k, r] == (t, pytest.approx(y, abs=1e-9))


def test_a_million_rounds_of_one_coordinate(spark):
    n = 1_000_000
    d = spark.range(n).select(F.lit("p").alias("k"), F.col("id").alias("round"), (F.col("id") % 7).cast("double").alias("value"))
    last = st.momentum(d, ["k"]).where(F.col("round") >= n - 3).orderBy("round").collect()
    x = np.arange(n - 1000, n) % 7
    y = 0.0
    for v in x:
        y = 0.9 * y + v
    assert last[-1]["value"] == pytest.approx(y) and len(last) == 3
    plan = st.momentum(d, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan


def test_streamed_state_ends_with_its_key(spark):
    rows = [(k, t, float(t)) for k in range(5) for t in range(20)]
    df = spark.createDataFrame(rows, "k int, round int, v double")
    out = scan.streamed(df, ["k"], "round", ["v"], ["total"], [0.0], lambda s, x: [s[0] + x[0]]).collect()
    assert all(r["total"] == sum(range(r["round"] + 1)) for r in out)


# -- moving rounds

LOG = "seq bigint, kind string, grp bigint, round bigint, param string, idx int, value double, w double"


def log_rows(n):
    """Three rounds open at 0, 10 and 20; updates of two coordinates each."""
    rows = [(s, "round", 0, s // 10, None, None, None, None) for s in range(0, n, 10)]
    for s in range(n):
        lag = s % 4
        rows += [(s, "update", 0, s // 10 - lag, "p", i, float(s + i), 1.0 + i) for i in (0, 5000)]
    return rows


def expected(rows, least, most, base=0.99):
    out = []
    for block in (0, 1):
        waiting = []
        for s in sorted({r[0] for r in rows if r[1] == "update"}):
            r = next(x for x in rows if x[0] == s and x[1] == "update" and x[5] // 4096 == block)
            lag = s // 10 - r[3]
            if lag <= most:
                waiting.append((r[6], r[7] * base**lag))
                if len(waiting) == least:
                    out.append((block, sum(v * w for v, w in waiting) / sum(w for _, w in waiting), least))
                    waiting = []
    return sorted(out)


def write_part(spark, rows, path):
    spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(path)


def released(spark, path):
    return sorted((r["block"], r["value"], r["n"]) for r in spark.read.parquet(path).collect())


def test_a_restart_loses_and_repeats_nothing(spark):
    """Parts that end anywhere, a stream that ends after each: the same releases as of the whole log by definition."""
    log, chk, out = (new_path(spark, x) for x in ("log", "chk", "out"))
    rows = log_rows(33)
    blocks = spark.createDataFrame([(0, "p", 0), (0, "p", 1)], "grp bigint, param string, block bigint")
    for lo, hi in ((0, 7), (7, 8), (8, 33)):
        write_part(spark, [r for r in rows if lo <= r[0] < hi], log)
        stream = spark.readStream.schema(LOG).parquet(log)
        moving.run_to_end(moving.moving_rounds(stream, blocks, 4, None, most=2), chk, out)
    got = released(spark, out)
    want = expected(rows, 4, 2)
    assert [(b, n) for b, _, n in got] == [(b, n) for b, _, n in want]
    assert [v for _, v, _ in got] == pytest.approx([v for _, v, _ in want])
    # staleness is as on arrival: with one part for all it is the same
    log2, chk2, out2 = (new_path(spark, x) for x in ("log", "chk", "out"))
    write_part(spark, rows, log2)
    moving.run_to_end(moving.moving_rounds(spark.readStream.schema(LOG).parquet(log2), blocks, 4, None, most=2), chk2, out2)
    assert [v for _, v, _ in released(spark, out2)] == pytest.approx([v for _, v, _ in got])


def test_a_hundred_thousand_updates_of_a_buffer_take_seconds(spark):
    """By definition, one update after the other; a loop of frames took a minute and more."""
    rng = np.random.default_rng(2)
    n = 100_000
    round_, value, w = rng.integers(0, 40, n), rng.normal(size=n), rng.random(n)
    opens = rng.random(n) < 0.01
    log, found, chk = (new_path(spark, x) for x in ("log", "found", "chk"))
    rows = [(i, "round", 0, int(round_[i]), None, None, None, None) if opens[i] else (i, "update", 0, int(round_[i]), "p", i % 3, None if i % 17 == 0 else float(value[i]), float(w[i])) for i in range(n)]
    spark.createDataFrame(rows, LOG).coalesce(1).write.parquet(log)
    blocks = spark.createDataFrame([(0, "p", 0)], "grp bigint, param string, block bigint")
    began = time.time()
    moving.run_to_end(moving.moving_rounds(spark.readStream.schema(LOG).parquet(log), blocks, 7, None, most=10), chk, found)
    assert time.time() - began < 30
    current, waiting, want, release = None, [], {}, 0
    for seq, kind, _, r, _, idx, v, weight in rows:
        if kind == "round":
            current = r
        elif (lag := (r if current is None else current) - r) <= 10:
            waiting.append((idx, v, weight * 0.99**lag))
            if len(waiting) == 7:
                for i in {i for i, x, _ in waiting if x is not None}:
                    here = [(x, y) for j, x, y in waiting if j == i and x is not None]
                    want[release, i] = sum(x * y for x, y in here) / sum(y for _, y in here)
                waiting, release = [], release + 1
    got = {(r["release"], r["idx"]): r["value"] for r in spark.read.parquet(found).collect()}
    assert got.keys() == want.keys()
    assert max(abs(got[k] - want[k]) for k in want) < 1e-9


def test_a_round_is_released_when_its_time_is_over(spark):
    """Without any further message, by a timer of a running stream."""
    log = new_path(spark, "log")
    write_part(spark, [r for r in log_rows(3) if r[5] in (None, 0)], log)
    blocks = spark.createDataFrame([(0, "p", 0)], "grp bigint, param string, block bigint")
    with moving.rocksdb_state(spark):
        stream = moving.moving_rounds(spark.readStream.schema(LOG).parquet(log), blocks, 100, 1500)
        query = stream.writeStream.format("memory").queryName("timed").option("checkpointLocation", new_path(spark, "chk")).outputMode("append").start()
    try:
        for _ in range(90):
            found = spark.table("timed").collect()
            if found:
                break
            time.sleep(0.5)
    finally:
        query.stop()
    assert [(r["reason"], r["n"], r["release"]) for r in found] == [("time", 3, 0)]
    w = [0.99**k for k in range(3)]
    assert found[0]["value"] == pytest.approx(sum(k * x for k, x in enumerate(w)) / sum(w))


# -- state of clients


def test_only_touched_buckets_are_written_and_a_broken_write_is_never_read(spark):
    state = ClientState(spark, new_path(spark, "state"), "client int, value double", 8)
    assert state.read().count() == 0 and state.client(3).count() == 0
    rows = spark.createDataFrame([(c, float(c)) for c in range(40)], "client int, value double")
    assert len(state.write(rows, 1)) == 8
    before = state._folders(None)[1]
    touched = state.write(rows.where("client = 5").withColumn("value", F.lit(-1.0)), 2)
    after = state._folders(None)[1]
    assert len(touched) == 1 and [b for b in range(8) if before[b] != after[b]] == touched
    assert {r["client"]: r["value"] for r in state.read().collect()} == {c: -1.0 if c == 5 else float(c) for c in range(40)}
    assert state.client(5).first()["value"] == -1.0 and state.client(5, 1).first()["value"] == 5.0
    assert state.read(1).where("value < 0").count() == 0
    # a write that fails leaves the last version
    bad = rows.withColumn("value", F.when(F.col("client") == 7, F.raise_error(F.lit("broken off")).cast("double")).otherwise(9.0))
    with pytest.raises(Exception, match="broken off"):
        state.write(bad, 3)
    assert state.read().where("value = 9 AND client <> 9").count() == 0
    with pytest.raises(ValueError):
        state.read(3)


# -- entropy coding


def test_codes_are_best_and_read_back():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 7):
        counts = rng.integers(1, 50, n).tolist()
        lengths = coding.code_lengths(counts)
        assert sum(2.0**-m for m in lengths) <= 1
        codes = coding.canonical(lengths)
        texts = [format(c, f"0{m}b") for c, m in zip(codes, lengths, strict=True)]
        assert not any(a != b and b.startswith(a) for a, b in itertools.permutations(texts, 2))
        if 1 < n <= 5:
            best = min(sum(c * m for c, m in zip(counts, ms, strict=True)) for ms in itertools.product(range(1, n), repeat=n) if sum(2.0**-m for m in ms) <= 1) if n > 1 else counts[0]
            assert sum(c * m for c, m in zip(counts, lengths, strict=True)) == best
    fib = [1, 1]
    while len(fib) < 80:
        fib.append(fib[-1] + fib[-2])
    assert max(coding.code_lengths(fib)) <= coding.DEEPEST


@pytest.mark.parametrize("how", ["huffman", "arithmetic"])
@pytest.mark.parametrize("alphabet", [3, 1000])
def test_coders_return_odd_values(spark, how, alphabet):
    rng = np.random.default_rng(5)
    words = ["", "a", "é", "日本" * 50, None, "x y", "\n", *[f"w{k}" for k in range(30)]]
    rows = [(g, i, words[min(len(words) - 1, int(rng.pareto(0.8)))]) for g in range(3) for i in range([700, 1, 40][g])]
    df = spark.createDataFrame(rows, "g int, i int, value string")
    table = coding.code_table(df, ["g"], alphabet=alphabet)
    coded = coding.entropy_encode(df, table, ["g"], "i", how, piece=64)
    back = coding.entropy_decode(coded, table, ["g"], how, kind="string")
    assert sorted((r["g"], r["pos"], r["value"] or "", r["value"] is None) for r in back.collect()) == sorted((g, i, v or "", v is None) for g, i, v in rows)
    assert coded.where("g = 0").count() == 11
    with pytest.raises(ValueError):
        coding.entropy_encode(df, table, ["g"], "i", "lzw")
    none = df.limit(0)
    assert coding.entropy_encode(none, coding.code_table(none, ["g"]), ["g"], "i", how).count() == 0


# -- transforms


@pytest.mark.parametrize("bits", [1, 2, 3, 12])
def test_haar_is_the_same_in_any_blocks_and_inverts(spark, bits):
    rng = np.random.default_rng(6)
    sizes = {1: 1, 2: 2, 3: 7, 4: 64, 5: 37}
    rows = [(c, i, float(rng.normal())) for c, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "client int, idx int, value double")
    levels = spark.createDataFrame(list(sizes.items()), "client int, n int")
    coefficients = transforms.haar(df, ("client",), bits)
    got = {(r["client"], r["level"], r["pos"]): r["value"] for r in coefficients.collect()}
    for c, n in sizes.items():
        x, want, level = np.array([v for k, _, v in rows if k == c]), {}, 0
        while len(x) > 1:
            level += 1
            m = len(x) // 2
            want |= {(c, level, k): (x[2 * k] - x[2 * k + 1]) / math.sqrt(2) for k in range(m)}
            x = np.append((x[: 2 * m : 2] + x[1 : 2 * m : 2]) / math.sqrt(2), x[2 * m :])
        want[c, 0, 0] = x[0]
        assert {k: v for k, v in got.items() if k[0] == c} == pytest.approx(want)
    back = {(r["client"], r["idx"]): r["value"] for r in transforms.haar_inverse(coefficients, levels, ("client",), bits).collect()}
    assert back == pytest.approx({(c, i): v for c, i, v in rows})
    few = transforms.haar_inverse(transforms.largest(coefficients, 0.01, ("client",)), levels, ("client",), bits)
    assert few.count() == len(rows)


def test_dft_in_blocks_inverts(spark):
    rng = np.random.default_rng(7)
    rows = [(c, i, float(rng.normal())) for c, n in ((1, 1), (2, 10), (3, 33)) for i in range(n)]
    df = spark.createDataFrame(rows, "client int, idx int, value double")
    z = transforms.dft(df, ("client",), 8)
    assert z.count() == 1 + (5 + 2) + (4 * 5 + 1)
    back = {(r["client"], r["idx"]): r["value"] for r in transforms.dft_inverse(z, df, ("client",), 8).collect()}
    assert back == pytest.approx({(c, i): v for c, i, v in rows}, abs=1e-9)
    few = transforms.largest(z, 0.1, ("client",), complex_=True)
    assert transforms.dft_inverse(few, df, ("client",), 8).count() == len(rows)


# -- bytes and bits


def test_raw_bytes_are_float32_by_name(spark):
    rng = np.random.default_rng(8)
    shapes = {"b": 5, "a": 3, "empty": 0, "c": 11}
    w = {p: rng.normal(size=n).astype(np.float32) for p, n in shapes.items()}
    rows = [("k", p, i, float(v)) for p, x in w.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "client string, param string, idx int, value double")
    table = spark.createDataFrame(list(shapes.items()), "param string, n int")
    for piece in (1, 4, 100):
        pieces = raw.to_bytes(df, table, piece=piece)
        data = b"".join(bytes(r["data"]) for r in pieces.orderBy("piece").collect())
        assert data == b"".join(w[p].tobytes() for p in sorted(w))
        back = raw.from_bytes(pieces, table, piece=piece)
        assert sorted(map(tuple, back.collect())) == sorted(rows)
    with pytest.raises(Exception, match="beyond its shape"):
        raw.to_bytes(df.withColumn("idx", F.col("idx") + 1), table).collect()


def test_pieces_of_one_number_are_unpacked_by_many_tasks(spark):
    """Each client's file is a piece of number 0; client 3 lacks all but one value, client 5 all."""
    rows = [(c, p, i, c + i / 8) for c in range(60) for p, n in (("a", 3), ("b", 4)) for i in range(n) if c != 3 or (p, i) == ("b", 2)]
    rows = [(c, p, i, None if c == 5 else v) for c, p, i, v in rows]
    df = spark.createDataFrame(rows, "client int, param string, idx int, value double")
    table = spark.createDataFrame([("a", 3), ("b", 4)], "param string, n int")
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        back = raw.from_bytes(raw.to_bytes(df, table), table).select("*", F.spark_partition_id().alias("task")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len({r["task"] for r in back}) > 1
    assert len(back) == 60 * 7
    got = {(r["client"], r["param"], r["idx"]): r["value"] for r in back if not math.isnan(r["value"])}
    assert got == {(c, p, i): v for c, p, i, v in rows if v is not None}


def test_shared_doubles_keep_every_bit(spark):
    x = [0.0, -0.0, 1 / 3, -1e308, 5e-324, float("inf"), float("-inf"), float("nan"), 2.0**53 + 1]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(x)] + [(99, None)], "client int, value double")
    shares = sec.share_doubles(df, 3, 5, 11, ("client",))
    for xs in ([1, 2, 3], [5, 3, 1]):
        got = {r["client"]: r["value"] for r in sec.reconstruct_doubles(shares, xs, 3, ("client",)).collect()}
        assert np.array([got[k] for k in range(len(x))]).tobytes() == np.array(x).tobytes() and len(got) == len(x)
    with pytest.raises(ValueError):
        sec.reconstruct_doubles(shares, [1, 2], 3, ("client",))


# -- subsets


def brute_subset(x, faulty, metric):
    n, best = len(x), None
    for k, s in enumerate(itertools.combinations(range(n), n - faulty)):
        y = x[list(s)]
        score = y.var(0).sum() if metric == "variance" else max(math.dist(a, b) for a in y for b in y)
        if best is None or score < best[0] * (1 - 1e-10):
            best = (score, k, set(s))
    return best


def client_rows(spark, x):
    return spark.createDataFrame([(0, f"c{c:02d}", "p", i, float(v), 1.0, 1) for c, row in enumerate(x) for i, v in enumerate(row)], SCHEMA)


@pytest.mark.parametrize("metric", ["variance", "max_dist"])
def test_subsets_by_brute_force(spark, metric):
    rng = np.random.default_rng(11)
    for x in (rng.normal(size=(9, 3)), rng.integers(0, 2, (8, 2)).astype(float), np.zeros((7, 2))):
        want = brute_subset(x, 3, metric)
        got = byz.subset_search(spark, client_rows(spark, x), 3, metric).collect()
        assert {int(r["client"][1:]) for r in got} == want[2] and {r["subset"] for r in got} == {want[1]}
        assert got[0]["score"] == pytest.approx(want[0], abs=1e-12)


@pytest.mark.parametrize("metric", ["variance", "max_dist"])
def test_thirty_clients_with_ten_faulty(spark, metric):
    """Some thirty million subsets, of which hardly any are looked at."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(30, 4))
    bad = set(rng.choice(30, 10, replace=False).tolist())
    for c in bad:
        x[c] += rng.normal(size=4) * 8 + 10
    got = byz.subset_search(spark, client_rows(spark, x), 10, metric).collect()
    assert {int(r["client"][1:]) for r in got} == set(range(30)) - bad


def test_subsets_where_clients_lack_coordinates(spark):
    rng = np.random.default_rng(13)
    rows = [(0, c, p, 0, float(rng.normal()), 1.0, 1) for c in "abcdef" for p in "xyz" if (c, p) not in {("a", "x"), ("d", "z")}]
    of = {(c, p): v for _, c, p, _, v, *_ in rows}
    best = min(((sum(np.var([of[c, p] for c in s if (c, p) in of]) for p in "xyz"), k, s) for k, s in enumerate(itertools.combinations("abcdef", 4))), key=lambda z: z[:2])
    got = byz.subset_search(spark, spark.createDataFrame(rows, SCHEMA), 2).collect()
    assert {r["client"] for r in got} == set(best[2]) and {r["subset"] for r in got} == {best[1]}


def test_numbers_of_subsets():
    from fedloom.operators.subsets import rank, unrank

    for k, s in enumerate(itertools.combinations(range(7), 3)):
        assert rank(list(s), 7) == k and unrank(k, 7, 3) == list(s)


@pytest.mark.parametrize("clients", [1, 2, 5, 40])
def test_masks_cancel_over_the_ring(spark, clients):
    rows = [(c, "p", i, c + i / 8) for c in range(clients) for i in range(3)]
    df = spark.createDataFrame(rows, "client int, param string, idx int, value double")
    m = sec.masked(df, df.select("client"), 3, neighbours=4)
    total = {r["idx"]: r["value"] for r in m.groupBy("idx").agg(sec.field(F.sum("masked")).alias("t")).select("idx", sec.decode(F.col("t")).alias("value")).collect()}
    assert total == pytest.approx({i: sum(c + i / 8 for c in range(clients)) for i in range(3)})
    if clients > 1:
        plain = {(r["client"], r["idx"]) for r in m.join(df.withColumn("plain", sec.encode(F.col("value"))), ["client", "param", "idx"]).where("masked = plain").collect()}
        assert not plain


def test_medians_of_small_and_large_groups_agree(spark):
    rng = np.random.default_rng(15)
    rows = [(g, f"c{c}", p, i, float(rng.normal()), float(rng.integers(1, 4)), 1) for g in range(3) for c in range(7) for p in "ab" if rng.random() < 0.8 for i in range(3)]
    rows += [rows[0], (1, "c0", "a", 0, None, 1.0, 1), (9, "c0", "z", 0, 4.0, 1.0, 1)]
    u = spark.createDataFrame(rows, SCHEMA)
    one, other = ({(r["grp"], r["param"], r["idx"]): r["value"] for r in byz.geometric_median(spark, u, 30, held=h).collect()} for h in (1 << 20, 10))
    assert one.keys() == other.keys() and one == pytest.approx(other, abs=1e-9)
    assert byz.geometric_median(spark, u.limit(0)).count() == 0


def test_pieces_of_a_code_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(coding, "PIECE", 64)
    df = spark.range(1000).select(F.lit(0).alias("g"), F.col("id").alias("i"), (F.col("id") % 5).cast("double").alias("value"))
    table = coding.code_table(df, ["g"])
    for how in ("huffman", "arithmetic"):
        coded = coding.entropy_encode(df, table, ["g"], "i", how, piece=1 << 40)
        assert coded.agg(F.max("n")).first()[0] == 64
        assert [r["value"] for r in coding.entropy_decode(coded, table, ["g"], how).orderBy("pos").collect()] == [float(i % 5) for i in range(1000)]


def test_noise_of_many_runs_is_searched_in_seconds(spark):
    runs = spark.range(200_000).select(F.col("id").alias("run"), (1.0 + F.col("id") % 20).alias("target_epsilon"), F.lit(0.01).alias("sample_rate"), (100 + F.col("id") % 900).alias("steps"))
    began = time.time()
    got = {r["run"]: r["noise"] for r in dp.noise_for_target(runs, "standard").where("run % 1000 = 7").collect()}
    assert time.time() - began < 25
    for run, z in got.items():
        steps, target = 100 + run % 900, 1.0 + run % 20
        spent = [min(steps * a / (2 * s * s) + math.log(1e5) / (a - 1) for a in dp.ORDERS) for s in (z, z - 1e-9)]
        assert z > 9.9999 or spent[0] <= target * (1 + 1e-9) and spent[1] > target * (1 - 1e-9)


def test_transforms_of_many_short_vectors_take_seconds(spark):
    n = 20_000
    u = spark.range(n * 9).select((F.col("id") % n).alias("client"), F.floor(F.col("id") / n).cast("int").alias("idx"), F.sin(F.col("id")).alias("value"))
    sizes = u.groupBy("client").agg(F.count("*").alias("n"))
    began = time.time()
    for back in (transforms.haar_inverse(transforms.haar(u, ("client",), 1), sizes, ("client",), 1), transforms.dft_inverse(transforms.dft(u, ("client",), 2), u, ("client",), 2)):
        met = back.withColumnRenamed("value", "v").join(u, ["client", "idx"]).agg(F.count("*"), F.max(F.abs(F.col("v") - F.col("value")))).first()
        assert met[0] == 9 * n and met[1] < 1e-12
    assert time.time() - began < 45
