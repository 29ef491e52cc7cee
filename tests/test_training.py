"""Settings, local training and whole rounds."""

import numpy as np
import pytest

from fedloom.config import Compression, Defense, Privacy, Rounds, Settings
from fedloom.operators import state, training
from fedloom.sources import weights


def test_settings_are_checked_and_come_back():
    with pytest.raises(ValueError):
        Rounds(clients_per_round=2, min_clients=3)
    with pytest.raises(ValueError):
        Privacy(epsilon=0)
    with pytest.raises(ValueError):
        Defense(method="magic")
    s = Settings(Rounds(rounds=3), Privacy(), Defense(1, "krum"))
    assert Settings.from_dict(s.to_dict()) == s


@pytest.fixture(scope="module")
def world(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 2))
    y = x @ [2.0, -1.0] + 0.5
    rows = [(int(i % 6), float(a), float(b), float(v)) for i, ((a, b), v) in enumerate(zip(x, y, strict=True))]
    reg = spark.createDataFrame([(i, True, 1.0) for i in range(6)], "client int, enabled boolean, weight double")
    return x, y, spark.createDataFrame(rows, "client int, a double, b double, y double"), reg


def test_local_updates_are_gradient_steps(world):
    x, y, data, _ = world
    got = {}
    for r in training.local_updates(training.client_sums(data, ["a", "b"], "y"), [0.1, 0.2, 0.3], 2, 0.1).collect():
        got[r["client"], r["idx"]] = r["value"]
    xc, yc = np.c_[x[::6], np.ones(len(x[::6]))], y[::6]
    w = np.array([0.1, 0.2, 0.3])
    for _ in range(2):
        w = w - 0.1 * xc.T @ (xc @ w - yc) / len(yc)
    assert [got[0, i] for i in range(3)] == pytest.approx((w - [0.1, 0.2, 0.3]).tolist())


@pytest.mark.parametrize("defense", ["none", "median"])
def test_rounds_find_the_weights(spark, world, defense):
    *_, data, reg = world
    s = Settings(Rounds(rounds=6, clients_per_round=6, strategy="fedavg"), defense=Defense(1 if defense != "none" else 0, defense))
    w, errors = training.run_rounds(spark, data, reg, ["a", "b"], "y", s, epochs=20, lr=0.2)
    assert w == pytest.approx([2.0, -1.0, 0.5], abs=0.05) and errors[-1] < errors[0] / 100


def test_too_few_clients_change_nothing(spark, world):
    *_, data, reg = world
    w, errors = training.run_rounds(spark, data, reg.where("client < 2"), ["a", "b"], "y", Settings(Rounds(rounds=2, clients_per_round=3)))
    assert w == [0.0, 0.0, 0.0] and errors[0] == pytest.approx(errors[1])


def test_unknown_strategies_are_refused_at_once():
    with pytest.raises(ValueError, match="fedavgg"):
        Rounds(strategy="fedavgg")


@pytest.mark.parametrize("strategy", ["fedadam", "scaffold"])
def test_resumed_rounds_equal_uninterrupted_ones(spark, world, tmp_path, strategy):
    *_, data, reg = world
    run = lambda n, **more: training.run_rounds(spark, data, reg, ["a", "b"], "y", Settings(Rounds(rounds=n, clients_per_round=4, strategy=strategy, checkpoint_every=2)), **more)
    whole = run(4)
    run(3, checkpoints=f"{tmp_path}/c")
    w, errors = run(4, checkpoints=f"{tmp_path}/c", resume=True)
    assert w == pytest.approx(whole[0]) and errors == pytest.approx(whole[1])


def test_rounds_end_when_the_budget_is_used_up(spark, world):
    *_, data, reg = world
    s = Settings(Rounds(rounds=9, clients_per_round=6), Privacy(epsilon=1.0, noise_multiplier=0.1))
    _, errors = training.run_rounds(spark, data, reg, ["a", "b"], "y", s)
    assert len(errors) == 3  # 0.48 a round: two are within 1


def test_a_callback_ends_rounds(spark, world):
    *_, data, reg = world
    seen = []
    training.run_rounds(spark, data, reg, ["a", "b"], "y", Settings(Rounds(rounds=5, clients_per_round=6)), on_round=lambda t, w, e: seen.append(t) or t < 1)
    assert seen == [0, 1]


@pytest.mark.parametrize("method, share", [("top_k", 0.4), ("quantization", 1.0), ("sign", 1.0)])
def test_clients_send_what_compression_restores(world, method, share):
    *_, data, _ = world
    u = training.local_updates(training.client_sums(data, ["a", "b"], "y"), [0.0, 0.0, 0.0])
    s = Settings(compression=Compression(method, share, 16))
    got = {(r["client"], r["idx"]): r["value"] for r in training.client_step(u, s, 0).collect()}
    for client in range(6):
        v = np.array([r["value"] for r in sorted(u.where(f"client = {client}").collect(), key=lambda r: r["idx"])])
        if method == "top_k":
            want = np.where(abs(v) == abs(v).max(), v, 0.0)
        elif method == "sign":
            want = np.where(v > 0, 1, -1) * abs(v).mean()
        else:
            want = v.min() + np.rint((v - v.min()) / (np.ptp(v) + 1e-10) * 15) / 15 * np.ptp(v)
        assert [got[client, i] for i in range(3)] == pytest.approx(want.tolist())


def test_advance_equals_the_fold_and_keeps_absent_coordinates(spark):
    rows = [("p", r, float(r * r - 3)) for r in range(4)]
    deltas = spark.createDataFrame([*rows, ("q", 1, 2.0)], "param string, round int, value double")
    want = {r["param"]: r["value"] for r in state.adam(deltas, ["param"]).orderBy("round").collect()}
    held = None
    for r in range(4):
        held = state.advance(held, deltas.where(f"round = {r}").drop("round"), ["param"], state.adam_rule())
        if r == 1:
            second = {x["param"]: (x["t"], x["value"]) for x in held.collect()}
    last = {x["param"]: (x["t"], x["value"], x["m"]) for x in held.collect()}
    assert last["p"][:2] == (4, pytest.approx(want["p"])) and second["q"] == (1, pytest.approx(want["q"]))
    assert last["q"] == (1, 0.0, pytest.approx(0.2))


def test_runs_are_read_only_once_they_are_whole(spark, tmp_path):
    path, one = f"{tmp_path}/run", lambda v: {"weights": spark.createDataFrame([(v,)], "value double")}
    weights.save_run(path, 1, one(1.0))
    weights.save_run(path, 3, one(3.0))
    weights.save_run(path, 1, one(1.5))
    spark.range(1).write.parquet(f"{path}/broken-off/weights")
    assert weights.load_run(spark, path)[0] == 3
    assert weights.load_run(spark, path, 1)[1]["weights"].first()["value"] == 1.5
    with pytest.raises(ValueError, match="2"):
        weights.load_run(spark, path, 2)
