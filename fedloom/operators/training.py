"""Local training of linear models, and rounds that depend on the weights of the round before.

Full-batch gradient steps of a linear model need only sums over a client's rows. Those are aggregated once,
before any shuffle, so a client with a third of all rows is no heavier than another; the steps then run on a
few numbers for each client.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..plans.session import work_table
from ..sources import weights as weights_io
from . import aggregate, compress, privacy, robust, rounds, state


def client_sums(data: DataFrame, features: Sequence[str], label: str, client: str = "client") -> DataFrame:
    """client, n and the sums of products of the features (a constant last) among themselves and with the label."""
    cols = [F.col(c).cast("double") for c in features] + [F.lit(1.0)]
    y = F.col(label).cast("double")
    d = len(cols)
    xx = F.array(*[F.sum(cols[i] * cols[j]) for i in range(d) for j in range(d)])
    return data.groupBy(F.col(client).alias("client")).agg(F.count("*").alias("n"), xx.alias("xx"), F.array(*[F.sum(c * y) for c in cols]).alias("xy"))


def local_updates(sums: DataFrame, weights: Sequence[float], epochs: int = 1, lr: float = 0.1) -> DataFrame:
    """(grp = 0, client, param, idx, value, w, steps): what `epochs` gradient steps of the mean squared error from the given weights change."""
    start = np.array(weights)
    kind = sums.schema["client"].dataType.simpleString()

    def run(frames):
        for f in frames:
            out = []
            for client, n, xx, xy in f[["client", "n", "xx", "xy"]].itertuples(index=False):
                a, b, w = np.array(xx).reshape(len(start), -1) / n, np.array(xy) / n, start.copy()
                for _ in range(epochs):
                    w -= lr * (a @ w - b)
                out += [(0, client, "weights", i, float(v), float(n), epochs) for i, v in enumerate(w - start)]
            yield pd.DataFrame(out, columns=["grp", "client", "param", "idx", "value", "w", "steps"])

    return sums.mapInPandas(run, f"grp int, client {kind}, param string, idx int, value double, w double, steps int")


def combined(spark: SparkSession, updates: DataFrame, settings: Settings) -> DataFrame:
    """(grp, idx, value) by the settings' defense, else by their strategy."""
    faulty, method = settings.defense.faulty, settings.defense.method
    if method in ("krum", "multi_krum"):
        return robust.krum_mean(updates, faulty, method == "multi_krum")
    if method == "trimmed_mean":
        return aggregate.trimmed_mean(updates, faulty=faulty)
    if method == "median" or settings.rounds.strategy == "fedmed":
        return aggregate.coordinate_median(updates)
    if method == "geometric_median":
        return robust.geometric_median(spark, updates)
    if settings.rounds.strategy == "fednova":
        return aggregate.weighted_mean(updates, weight=aggregate.nova_weight())
    return aggregate.weighted_mean(updates)


def server_rule(strategy: str) -> state.Rule | None:
    """What the server does with a round's mean before it is added; None adds it as it is. Clients of a round are never late, so async is the plain mean."""
    rules = {"fedavgm": state.momentum_rule, "fedadam": state.adam_rule, "fedyogi": state.yogi_rule, "fedadagrad": state.adagrad_rule, "scaffold": state.control_rule}
    return rules[strategy]() if strategy in rules else None


def client_step(updates: DataFrame, settings: Settings, seed: int) -> DataFrame:
    """What clients send: clipped, compressed to what the server restores, and perturbed, each if set."""
    if settings.privacy:
        updates = privacy.clip(updates, ["client"], settings.privacy.max_norm)
    if settings.compression:
        c = settings.compression
        packed = compress.compress(updates, c.method, c.share, c.levels, seed)
        updates = compress.decompress(packed, updates.drop("value"), ["client", "param", "idx"]).select(updates.columns)
    if settings.privacy:
        updates = privacy.add_gaussian(updates, settings.privacy.noise_multiplier * settings.privacy.max_norm, seed)
    return updates


def run_rounds(
    spark: SparkSession, data: DataFrame, registry: DataFrame, features: Sequence[str], label: str, settings: Settings, epochs: int = 1, lr: float = 0.1, seed: int = 0,
    on_round: Callable[[int, list[float], float], bool | None] | None = None, checkpoints: str | None = None, resume: bool = False,
) -> tuple[list[float], list[float]]:
    """Weights (features, then the constant) and the mean squared error before each round.

    Each round samples clients, trains them from the last weights, clips, compresses and perturbs if set, combines
    the updates, lets the strategy's rule act on the mean, and adds the result. A round with fewer than min_clients
    clients changes nothing. Rounds end early after early_stopping rounds without an error lower by min_delta, when
    the privacy budget is used up, or when on_round returns False. Only the model's few numbers come to the driver.
    With a folder for checkpoints, every checkpoint_every rounds the weights, the strategy's state, the registry and
    the history are written there; resume goes on after the last of these as if nothing had happened.
    """
    sums = work_table(spark, client_sums(data, features, label), "client-sums")
    total_y = data.agg(F.sum(F.col(label).cast("double") ** 2)).first()[0] or 0.0
    d = len(features) + 1
    whole = sums.agg(F.sum("n").alias("n"), *[F.sum(F.col("xx")[i]).alias(f"a{i}") for i in range(d * d)], *[F.sum(F.col("xy")[i]).alias(f"b{i}") for i in range(d)]).first()
    n = whole["n"] or 1
    a, b = np.array([whole[f"a{i}"] or 0.0 for i in range(d * d)]).reshape(d, d), np.array([whole[f"b{i}"] or 0.0 for i in range(d)])
    weights, history, first = np.zeros(d), [], 0
    held = None
    if resume:
        last, tables = weights_io.load_run(spark, checkpoints)
        registry, held, first = tables["registry"], tables.get("state"), last + 1
        history = [(h["round"], h["error"], h["clients"], h["seconds"]) for h in tables["history"].orderBy("round").collect()]
        for row in tables["weights"].collect():
            weights[row["idx"]] = row["value"]
    best, idle = np.inf, 0
    r, rule = settings.rounds, server_rule(settings.rounds.strategy)
    for h in history:
        best, idle = (h[1], 0) if h[1] < best - r.min_delta else (best, idle + 1)
    enabled = registry.where("enabled")
    known = enabled.count() if settings.privacy else 0
    for t in range(first, r.rounds):
        began = time.monotonic()
        error = float((weights @ a @ weights - 2 * weights @ b + total_y) / n)
        best, idle = (error, 0) if error < best - r.min_delta else (best, idle + 1)
        go_on = on_round is None or on_round(t, weights.tolist(), error) is not False
        spent_up = False
        if settings.privacy:
            p = settings.privacy
            rate = min(1.0, r.clients_per_round / max(known, 1))
            spent_up = privacy.spent_by_rounds(p.accounting, rate, p.noise_multiplier, t + 1, p.delta) > p.epsilon
        if not go_on or spent_up or r.early_stopping and idle >= r.early_stopping:
            history.append((t, error, 0, time.monotonic() - began))
            break
        sample = rounds.sample_uniform if r.sampling == "uniform" else rounds.sample_weighted
        chosen = sample(enabled, r.clients_per_round, seed + t)
        updates = local_updates(sums.join(chosen.select("client"), "client", "left_semi"), weights.tolist(), epochs, lr)
        updates = work_table(spark, client_step(updates, settings, seed + t), "round-updates")
        clients = updates.select("client").distinct().count()
        if clients >= r.min_clients:
            change = combined(spark, updates, settings)
            if rule:
                held = change = work_table(spark, state.advance(held, change, ("param", "idx"), rule), "round-state")
            for row in change.collect():
                weights[row["idx"]] += row["value"]
        history.append((t, error, clients, time.monotonic() - began))
        if checkpoints and (t + 1) % r.checkpoint_every == 0:
            rows = [("weights", i, float(v)) for i, v in enumerate(weights)]
            tables = {"weights": spark.createDataFrame(rows, "param string, idx int, value double"), "registry": registry}
            tables["history"] = spark.createDataFrame(history, "round int, error double, clients int, seconds double")
            weights_io.save_run(checkpoints, t, tables | ({"state": held} if held is not None else {}))
    return weights.tolist(), [h[1] for h in history]
