"""Aggregation with state across rounds.

Deltas have the columns keys + (round, value), a value for each of a key's rounds. Linear recurrences are parallel
scans over blocks of rounds (scan.linear_scan), sums are windows, Yogi is a stream of rows with its state beside it.
fold is for short histories: it goes over an array of a key's rounds.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.client_state import ClientState
from . import aggregate
from .scan import linear_scan, streamed


class Rule(NamedTuple):
    """State columns before the first round, and step(state, value, t), which gives those after one; the column value is what a round applies."""

    start: dict[str, float]
    step: Callable[[Column, Column, Column], dict[str, Column]]


def fold(deltas: DataFrame, keys: Sequence[str], start: dict[str, Column], step: Callable[[Column, Column, Column], dict[str, Column]]) -> DataFrame:
    """keys, round and state columns after each round. step(state, value, t) gives the next state, t counts from 1."""
    rounds = deltas.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("round", "value"))).alias("_rs"))
    kind = "struct<round:bigint," + ",".join(f"{k}:double" for k in start) + ">"

    def record(round_: Column, state: dict[str, Column]) -> Column:
        return F.struct(round_.cast("bigint").alias("round"), *[v.cast("double").alias(k) for k, v in state.items()]).cast(kind)

    first = record(F.lit(-1), start)

    def go(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        return F.concat(acc, F.array(record(x["round"], step(last, x["value"], F.size(acc)))))

    states = F.aggregate("_rs", F.array(first), go, lambda acc: F.slice(acc, F.lit(2), F.size(acc) - 1))
    return rounds.select(*keys, F.explode(states).alias("_s")).select(*keys, "_s.*")


def advance(state: DataFrame | None, delta: DataFrame, keys: Sequence[str], rule: Rule) -> DataFrame:
    """keys, t and state columns after one more round, from those after the last one (None before the first).

    Rounds in a loop thus cost the same each, whatever their number. A coordinate without a delta keeps its state and has the value 0; t counts a
    coordinate's own rounds.
    """
    names = list(rule.start)
    zero = F.struct(*[F.lit(v).cast("double").alias(k) for k, v in rule.start.items()])
    if state is None:
        joined = delta.select(*keys, F.col("value").alias("_d"), F.lit(0).alias("_t"), zero.alias("_s"))
    else:
        old = state.select(*keys, F.col("t").alias("_t"), F.struct(*names).alias("_s"))
        joined = old.join(delta.select(*keys, F.col("value").alias("_d")), list(keys), "full").withColumn("_t", F.coalesce("_t", F.lit(0))).withColumn("_s", F.coalesce("_s", zero))
    t = (F.col("_t") + 1).cast("int")
    new = rule.step(F.col("_s"), F.col("_d"), t)
    kept = {k: F.lit(0.0) if k == "value" else F.col("_s")[k] for k in names}
    met = F.col("_d").isNotNull()
    return joined.select(*keys, F.when(met, t).otherwise(F.col("_t")).alias("t"), *[F.when(met, new[k].cast("double")).otherwise(kept[k]).alias(k) for k in names])


def fold_rule(deltas: DataFrame, keys: Sequence[str], rule: Rule) -> DataFrame:
    return fold(deltas, keys, {k: F.lit(v) for k, v in rule.start.items()}, rule.step)


def momentum_rule(m: float = 0.9) -> Rule:
    return Rule({"value": 0.0, "b": 0.0}, lambda s, v, t: {"value": m * s["b"] + v, "b": m * s["b"] + v})


def _rounds(deltas: DataFrame, keys: Sequence[str]) -> DataFrame:
    return deltas.where("value IS NOT NULL").select(*keys, F.col("round").cast("bigint").alias("round"), F.col("value").alias("_v"))


def momentum(deltas: DataFrame, keys: Sequence[str], m: float = 0.9) -> DataFrame:
    """b = m b + delta from 0. A round without a value doesn't count."""
    return linear_scan(_rounds(deltas, keys), keys, {"value": (m, F.col("_v"))}).select(*keys, "round", "value")


def momentum_rounds(updates: DataFrame, keys: Sequence[str], m: float = 0.9, weight: Column | str = "w", globals_: DataFrame | None = None, mu: float = 0.0) -> DataFrame:
    """Momentum over each round's mean of updates (keys + round, client, value): weighed as asked, such as by nova_weight(), and drawn toward global values by mu if there are any.

    Updates that controls correct are given as control_correction leaves them. Rounds without an update of a coordinate don't count for it.
    """
    mean = aggregate.weighted_mean(updates, (*keys, "round"), weight=weight)
    return momentum(mean if globals_ is None else aggregate.toward(mean, globals_, mu, keys), keys, m)


def cluster_rounds(updates: DataFrame, cluster: str, keys: Sequence[str], start: DataFrame | None = None) -> DataFrame:
    """keys, round and the global value after it: the start (0 where it has none) plus, of all rounds so far, the plain means of clusters' weighted means.

    One shuffle by cluster, round and coordinate, combined before it; the sum over rounds has a row for each round.
    """
    change = aggregate.hierarchical_mean(updates, cluster, ("round", *keys))
    over = W.partitionBy(*keys).orderBy("round").rowsBetween(W.unboundedPreceding, 0)
    moved = change.select(*keys, "round", F.sum("value").over(over).alias("value"))
    return moved if start is None else aggregate.apply_delta(moved, start, keys, strict=False)


def running_average(deltas: DataFrame, keys: Sequence[str], decay: float = 0.99, from_first: bool = True) -> DataFrame:
    """r = d r + (1 - d) value, from the first value or from 0."""
    x = _rounds(deltas, keys)
    scanned = linear_scan(x, keys, {"value": (decay, (1 - decay) * F.col("_v"))})
    if from_first:
        # the first value counts whole: what it lacks fades with the rounds since
        first = x.groupBy(*keys).agg((decay * F.min_by("_v", "round")).alias("_f"))
        scanned = scanned.join(first, list(keys)).withColumn("value", F.col("value") + F.pow(F.lit(decay), F.col("_t") - 1) * F.col("_f"))
    return scanned.select(*keys, "round", "value")


def gradient_estimate(deltas: DataFrame, keys: Sequence[str], m: float = 0.9, decay: float = 0.99) -> DataFrame:
    """m times the running average before a round plus (1 - m) times the round's value; the value itself in the first round."""
    avg = running_average(deltas, keys, decay).withColumnRenamed("value", "_e")
    joined = deltas.withColumn("round", F.col("round").cast("bigint")).join(avg, [*keys, "round"])
    before = F.lag("_e").over(W.partitionBy(*keys).orderBy("round"))
    return joined.withColumn("_b", before).select(*keys, "round", F.coalesce(m * F.col("_b") + (1 - m) * F.col("value"), F.col("value")).alias("value"))


def adam_rule(lr: float = 0.01, b1: float = 0.9, b2: float = 0.99, eps: float = 1e-8, tau: float = 1e-7) -> Rule:
    def step(s: Column, v: Column, t: Column) -> dict[str, Column]:
        m, n = b1 * s["m"] + (1 - b1) * v, b2 * s["v"] + (1 - b2) * v * v
        m_hat, n_hat = m / (1 - F.pow(F.lit(b1), t)), n / (1 - F.pow(F.lit(b2), t))
        return {"m": m, "v": n, "value": lr * m_hat / (F.sqrt(n_hat) + eps + tau)}

    return Rule({k: 0.0 for k in ("m", "v", "value")}, step)


def adam(deltas: DataFrame, keys: Sequence[str], lr: float = 0.01, b1: float = 0.9, b2: float = 0.99, eps: float = 1e-8, tau: float = 1e-7) -> DataFrame:
    """keys, round, m, v and value: both moments are scans, the step follows from them and the number of rounds so far."""
    x = linear_scan(_rounds(deltas, keys), keys, {"m": (b1, (1 - b1) * F.col("_v")), "v": (b2, (1 - b2) * F.col("_v") * F.col("_v"))})
    m_hat, n_hat = F.col("m") / (1 - F.pow(F.lit(b1), F.col("_t"))), F.col("v") / (1 - F.pow(F.lit(b2), F.col("_t")))
    return x.select(*keys, "round", "m", "v", (lr * m_hat / (F.sqrt(n_hat) + eps + tau)).alias("value"))


def yogi_rule(lr: float = 0.01, b1: float = 0.9, b2: float = 0.99, eps: float = 1e-8, v0: float = 1e-3) -> Rule:
    """The second moment moves by the sign of v - (1 - b2) delta^2."""
    def step(s: Column, v: Column, t: Column) -> dict[str, Column]:
        sq = (1 - b2) * v * v
        m = b1 * s["m"] + (1 - b1) * v
        n = b2 * s["v"] + F.signum(s["v"] - sq) * sq
        m_hat, n_hat = m / (1 - F.pow(F.lit(b1), t)), F.abs(n) / (1 - F.pow(F.lit(b2), t))
        return {"m": m, "v": n, "value": lr * m_hat / (F.sqrt(n_hat) + eps)}

    return Rule({"m": 0.0, "v": v0, "value": 0.0}, step)


def yogi(deltas: DataFrame, keys: Sequence[str], lr: float = 0.01, b1: float = 0.9, b2: float = 0.99, eps: float = 1e-8, v0: float = 1e-3) -> DataFrame:
    """keys, round, m, v and value. The second moment's sign depends on itself, so it isn't a scan: each key's rows stream by with their state."""

    def step(state: list[float], row: tuple) -> list[float]:
        _, m, n, t = state
        sq = (1 - b2) * row[0] * row[0]
        m, n, t = b1 * m + (1 - b1) * row[0], b2 * n + ((n > sq) - (n < sq)) * sq, t + 1
        return [lr * (m / (1 - b1**t)) / (math.sqrt(abs(n) / (1 - b2**t)) + eps), m, n, t]

    x = streamed(_rounds(deltas, keys), keys, "round", ["_v"], ["value", "m", "v"], [0.0, 0.0, v0, 0.0], step)
    return x.select(*keys, "round", "m", "v", "value")


def adagrad_rule(lr: float = 0.01, eps: float = 1e-8, start: float = 0.1) -> Rule:
    def step(s: Column, v: Column, t: Column) -> dict[str, Column]:
        g = s["g"] + v * v
        return {"g": g, "value": lr * v / (F.sqrt(g) + eps)}

    return Rule({"g": start, "value": 0.0}, step)


def control_rule(control_lr: float = 1.0) -> Rule:
    """Updates corrected by the server's control (clients' controls stay 0), which then moves against the corrected mean."""
    def step(s: Column, v: Column, t: Column) -> dict[str, Column]:
        fixed = v + s["c"]
        return {"c": s["c"] - control_lr * fixed, "value": fixed}

    return Rule({"c": 0.0, "value": 0.0}, step)


def adagrad(deltas: DataFrame, keys: Sequence[str], lr: float = 0.01, eps: float = 1e-8, start: float = 0.1) -> DataFrame:
    """A running sum of squares, as a window."""
    over = W.partitionBy(*keys).orderBy("round").rowsBetween(W.unboundedPreceding, 0)
    total = F.lit(start) + F.sum(F.col("value") * F.col("value")).over(over)
    return deltas.withColumn("_g", total).select(*keys, "round", (lr * F.col("value") / (F.sqrt("_g") + eps)).alias("value"))


def server_control(deltas: DataFrame, keys: Sequence[str], control_lr: float = 1.0, start: float = 0.0) -> DataFrame:
    """c = start - control_lr times the running sum of deltas."""
    over = W.partitionBy(*keys).orderBy("round").rowsBetween(W.unboundedPreceding, 0)
    return deltas.select(*keys, "round", (F.lit(start) - control_lr * F.sum("value").over(over)).alias("value"))


def control_correction(updates: DataFrame, client_controls: DataFrame, control: DataFrame, on: Sequence[str]) -> DataFrame:
    """value - client's control + server's control; missing client controls are 0, without a server control nothing changes."""
    ci = client_controls.withColumnRenamed("value", "_ci")
    cs = control.withColumnRenamed("value", "_c")
    joined = updates.join(ci, ["client", *on], "left").join(cs, list(on), "left")
    fixed = F.col("value") - F.coalesce("_ci", F.lit(0.0)) + F.col("_c")
    return joined.withColumn("value", F.when(F.col("_c").isNull(), F.col("value")).otherwise(fixed)).drop("_ci", "_c")


def zero_controls(catalog: DataFrame, on: Sequence[str], clients: DataFrame | None = None) -> DataFrame:
    """Controls of 0 for every coordinate of a catalogue, for each client if any are given."""
    zero = catalog.select(*on).distinct().withColumn("value", F.lit(0.0))
    return zero if clients is None else clients.select("client").distinct().join(F.broadcast(zero)).select("client", *on, "value")


def client_controls(deltas: DataFrame, own: DataFrame, control: DataFrame | None, on: Sequence[str], lr: float = 1.0, steps: Column | int = 1) -> DataFrame:
    """client, on and value: the controls of clients that took part, c_i - c - delta / (steps lr); missing controls are 0.

    deltas (client, on, value) are what a client's local weights differ from the global ones by; steps may be a column of it.
    """
    n = F.greatest(steps if isinstance(steps, Column) else F.lit(steps), F.lit(1))
    x = deltas.withColumn("_d", F.col("value") / (n * lr)).drop("value").join(own.select("client", *on, F.col("value").alias("_ci")), ["client", *on], "left")
    x = x.join(control.select(*on, F.col("value").alias("_c")), list(on), "left") if control is not None else x.withColumn("_c", F.lit(0.0))
    return x.select("client", *on, (F.coalesce("_ci", F.lit(0.0)) - F.coalesce("_c", F.lit(0.0)) - F.col("_d")).alias("value"))


def control_round(deltas: DataFrame, state: ClientState, control: DataFrame | None, version: int, on: Sequence[str], lr: float = 1.0, control_lr: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """One round with moving client controls: (corrected deltas, the server's next control).

    deltas have client, on, value and w. They are corrected by the controls as they stand, the server's control moves
    against their weighted mean, and the clients that took part get new controls, written as a version of `state` of
    which only their buckets are rewritten.
    """
    own = state.read()
    zero = deltas.select(*on).distinct().withColumn("value", F.lit(0.0)) if control is None else control
    fixed = control_correction(deltas, own, zero, on)
    mean = aggregate.weighted_mean(fixed, on)
    moved = zero.join(mean.withColumnRenamed("value", "_m"), list(on), "full").select(*on, (F.coalesce("value", F.lit(0.0)) - control_lr * F.coalesce("_m", F.lit(0.0))).alias("value"))
    new = client_controls(deltas.select("client", *on, "value"), own, zero, on, lr)
    # a client's rows are replaced together, so what it has of coordinates without a delta goes along
    rest = own.select("client", *on, "value").join(deltas.select("client").distinct(), "client", "left_semi").join(new.select("client", *on), ["client", *on], "left_anti")
    state.write(new.unionByName(rest), version)
    return fixed, moved


def early_stopping(metrics: DataFrame, key: str, patience: int, min_delta: float) -> DataFrame:
    """best and counter after each round and whether to stop there; the first round seeds best."""
    def step(s: Column, v: Column, t: Column) -> dict[str, Column]:
        better = v > s["best"] + min_delta
        return {"best": F.when((t == 1) | better, v).otherwise(s["best"]), "counter": F.when((t == 1) | better, 0.0).otherwise(s["counter"] + 1)}

    out = fold(metrics, [key], {"best": F.lit(0.0), "counter": F.lit(0.0)}, step)
    return out.withColumn("stop", F.col("counter") >= patience)
