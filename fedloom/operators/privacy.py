"""Clipping, noise and privacy accounting.

The "reference" accounting formulas keep the figures of the engine that this one replaces; they are not valid
privacy guarantees. standard_rdp_epsilon is the usual bound.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import uniform
from ..plans.session import ship_package
from .selection import percentiles

#: 1.1 to 10.9 in steps of a tenth, then 12 to 63.
ORDERS = [1 + x / 10.0 for x in range(1, 100)] + [float(x) for x in range(12, 64)]


def clip(updates: DataFrame, by: Sequence[str], most: float = 1.0) -> DataFrame:
    """Values of each group (a row of a parameter, or a whole update) scaled to a norm of most at most."""
    norm = F.sqrt(F.sum(F.col("value") * F.col("value")).over(W.partitionBy(*by)))
    return updates.withColumn("_n", norm).withColumn("value", F.col("value") * F.least(F.lit(1.0), most / (F.col("_n") + 1e-6))).drop("_n")


def adaptive_norm(updates: DataFrame, by: Sequence[str], share: float = 0.5) -> DataFrame:
    """The percentile of group norms that clipping would use next, by radix selection: norms are never brought together. One row, null without norms."""
    norms = updates.groupBy(*by).agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("value"))
    found = percentiles(norms.select(F.lit(0).alias("all"), "value"), ["all"], share)
    return found.groupBy().agg(F.max("value").alias("max_norm"))


NOISE_KEY = ("client", "param", "idx")


def add_gaussian(updates: DataFrame, std: float, seed: int, key: Sequence[str] = NOISE_KEY) -> DataFrame:
    """Noise of a value by a hash of the seed and its key, so that partitions, retries and reruns don't change it (Box and Muller)."""
    normal = F.sqrt(-2 * F.log(uniform(seed, F.lit("r"), *key))) * F.cos(2 * math.pi * uniform(seed, F.lit("a"), *key))
    return updates.withColumn("value", F.col("value") + normal * std)


def add_laplace(updates: DataFrame, scale: float, seed: int, key: Sequence[str] = NOISE_KEY) -> DataFrame:
    """By the inverse of its distribution function at a hash of the seed and the value's key."""
    return updates.withColumn("_u", uniform(seed, *key) - 0.5).withColumn("value", F.col("value") - scale * F.signum("_u") * F.log(F.greatest(1 - 2 * F.abs("_u"), F.lit(1e-300)))).drop("_u")


def orders(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, a) for i, a in enumerate(ORDERS)], "i int, alpha double")


def rdp_per_order(log: DataFrame, orders_: DataFrame) -> DataFrame:
    """(i, alpha, rdp, steps): the reference formula summed over a log of (sample_rate, noise_multiplier, steps). The log is reduced to three sums first."""
    q, s, n = F.col("sample_rate"), F.col("noise_multiplier"), F.col("steps")
    sums = log.groupBy().agg(F.sum(n * q * q * s * s).alias("_a"), F.sum(n * q * q * q * s * s * s).alias("_b"), F.sum(n).alias("steps"))
    alpha = F.col("alpha")
    r = F.when(alpha < 2, 0.0).otherwise(0.5 * alpha * F.col("_a") + F.when(alpha > 2, (alpha - 1) * F.col("_b") / 6).otherwise(0.0))
    return orders_.join(F.broadcast(sums)).select("i", "alpha", r.alias("rdp"), "steps")


def rdp_epsilon(per_order: DataFrame, delta: float = 1e-5) -> DataFrame:
    """The first positive epsilon in the order of i, from the mean rdp of a step; steps / 100 if none is, 0 if all rdp are 0."""
    eps = F.col("rdp") / F.col("steps") * F.col("alpha") + math.log(delta) / (F.col("alpha") - 1)
    x = per_order.withColumn("_e", eps)
    first = F.min_by("_e", F.when(F.col("_e") > 0, F.col("i")))
    found = F.max((F.col("_e") > 0).cast("int")) == 1
    return x.groupBy().agg(F.when(F.max("rdp") == 0, 0.0).when(found, first).otherwise(F.max("steps") * 0.01).alias("epsilon"))


def gdp(log: DataFrame) -> DataFrame:
    q, s, n = F.col("sample_rate"), F.col("noise_multiplier"), F.col("steps")
    return log.groupBy().agg(F.sum(n * q).alias("mu"), F.sqrt(F.sum(n * q * q * s * s)).alias("sigma"))


def simple_epsilon(log: DataFrame, delta: float = 1e-5) -> DataFrame:
    return log.groupBy().agg((F.sum(F.col("steps") * F.col("sample_rate") * F.col("noise_multiplier")) * math.sqrt(2 * math.log(1 / delta))).alias("epsilon"))


def standard_rdp_epsilon(noise_multiplier: float, steps: int, delta: float) -> float:
    """The usual bound of the Gaussian mechanism without subsampling: least over orders of steps alpha / (2 sigma^2) + ln(1 / delta) / (alpha - 1)."""
    return min(steps * a / (2 * noise_multiplier**2) + math.log(1 / delta) / (a - 1) for a in ORDERS)


def compose(guarantees: DataFrame, how: str = "advanced") -> DataFrame:
    """(epsilon, delta) of several guarantees: their sums, the advanced bound, or sums with a root; zeros if there are none."""
    k = F.count("*")
    if how == "sequential":
        e, d = F.sum("epsilon"), F.sum("delta")
    elif how == "advanced":
        e, d = F.max("epsilon") * F.sqrt(2 * k * F.log(1 / F.max("delta"))), k * F.max("delta")
    else:
        e, d = F.sum("epsilon") * F.sqrt(k.cast("double")), F.sum("delta")
    return guarantees.groupBy().agg(F.coalesce(e, F.lit(0.0)).alias("epsilon"), F.coalesce(d, F.lit(0.0)).alias("delta"))


def calibrated_noise(epsilon: Column, delta: Column, sensitivity: Column, mechanism: str) -> Column:
    if mechanism == "gaussian":
        return F.sqrt(2 * F.log(1.25 / delta)) * sensitivity / epsilon
    if mechanism == "laplace":
        return sensitivity / epsilon
    raise ValueError(f"unknown mechanism {mechanism}")


def adaptive_noise(updates: DataFrame, base: float, by: Sequence[str], factor: float = 0.1) -> DataFrame:
    """base (1 + factor times the mean norm)."""
    norms = updates.groupBy(*by).agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
    return norms.groupBy().agg((base * (1 + factor * F.avg("norm"))).alias("noise"))


def optimal_noise(target_epsilon: float, sample_rate: float, steps: int, delta: float = 1e-5, rounds: int = 50) -> float:
    """The least noise multiplier in [0.01, 10] whose simple epsilon is within the target, by bisection on the driver."""
    spent = lambda s: steps * sample_rate * s * math.sqrt(2 * math.log(1 / delta))
    lo, hi = 0.01, 10.0
    for _ in range(rounds):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if spent(mid) <= target_epsilon else (lo, mid)
    return lo


def noise_for_target(runs: DataFrame, kind: str = "simple", delta: float = 1e-5, rounds: int = 50) -> DataFrame:
    """run and noise of (run, target_epsilon, sample_rate, steps): bisection in [0.01, 10] for each run by the named accountant, all runs in one pass.

    simple and rdp (the reference formulas, which grow with the noise): the largest multiplier within the target.
    gdp: its mu doesn't depend on the noise, so 10 if the target allows it and 0.01 if not. standard: the usual bound
    without subsampling, which falls as noise grows: the least multiplier within the target.
    """
    if kind not in ("simple", "rdp", "gdp", "standard"):
        raise ValueError(f"unknown accountant {kind}")
    spark = runs.sparkSession
    ship_package(spark)
    alphas = np.array(ORDERS, np.float64)

    def spent(s: np.ndarray, q: np.ndarray, n: np.ndarray) -> np.ndarray:
        if kind == "simple":
            return n * q * s * math.sqrt(2 * math.log(1 / delta))
        if kind == "gdp":
            return n * q
        if kind == "standard":
            found = np.full(len(s), np.inf)
            for a in alphas.tolist():
                np.minimum(found, n * a / (2 * s * s) + math.log(1 / delta) / (a - 1), out=found)
            return found
        qz, found, there = q * s, n * 0.01, np.zeros(len(s), bool)
        for a in alphas.tolist():
            # the first order whose epsilon is above 0 counts
            rdp = 0.0 if a < 2 else 0.5 * a * qz * qz + ((a - 1) * q * qz * qz * s / 6 if a > 2 else 0.0)
            eps = rdp * a + math.log(delta) / (a - 1) + np.zeros(len(s))
            found = np.where(~there & (eps > 0), eps, found)
            there |= eps > 0
        return found

    def run(batches):
        for batch in batches:
            target, q, n = (batch.column(k).cast(pa.float64()).to_numpy(zero_copy_only=False) for k in (1, 2, 3))
            lo, hi = np.full(len(q), 0.01), np.full(len(q), 10.0)
            with np.errstate(invalid="ignore", over="ignore"):
                for _ in range(rounds):
                    mid = (lo + hi) / 2
                    up = spent(mid, q, n) > target if kind == "standard" else spent(mid, q, n) <= target
                    lo, hi = np.where(up, mid, lo), np.where(up, hi, mid)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hi if kind == "standard" else lo)], names=["run", "noise"])

    rows = runs.select("run", *[F.col(c).cast("double").alias(c) for c in ("target_epsilon", "sample_rate", "steps")])
    # few bytes and much work: the number of tasks doesn't follow the size
    rows = rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), "run")
    return rows.mapInArrow(run, f"run {rows.schema['run'].dataType.simpleString()}, noise double")


def dp_step(updates: DataFrame, most: float, noise_multiplier: float, seed: int, by: Sequence[str] = ("client",), lr: float | None = None) -> DataFrame:
    """One private step: whole updates scaled to a norm of `most` at most, noise of noise_multiplier times that on every value, and, with a rate, minus that many times the result."""
    noisy = add_gaussian(clip(updates, by, most), noise_multiplier * most, seed)
    return noisy if lr is None else noisy.withColumn("value", -lr * F.col("value"))


def spent_so_far(log: DataFrame, order: str = "step", delta: float = 1e-5, total: float | None = None) -> DataFrame:
    """order, steps and epsilon after each entry of a log (order, sample_rate, noise_multiplier, steps) by the simple accountant, and whether a total is used up.

    Running sums are cut by stretches of the order: a table of stretch sums, and a window within each stretch.
    """
    cost = F.col("steps") * F.col("sample_rate") * F.col("noise_multiplier") * math.sqrt(2 * math.log(1 / delta))
    x = log.withColumn("_c", cost).withColumn("_p", F.floor(F.col(order) / 4096))
    sums = x.groupBy("_p").agg(F.sum("_c").alias("_c"), F.sum("steps").alias("_s"))
    line = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)  # a row for 4,096 entries
    before = sums.select("_p", F.coalesce(F.sum("_c").over(line), F.lit(0.0)).alias("_c0"), F.coalesce(F.sum("_s").over(line), F.lit(0)).alias("_s0"))
    within = W.partitionBy("_p").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    x = x.withColumn("_c1", F.sum("_c").over(within)).withColumn("_s1", F.sum("steps").over(within)).join(before, "_p")
    eps = F.col("_c0") + F.col("_c1")
    out = [F.col(order), (F.col("_s0") + F.col("_s1")).cast("bigint").alias("steps"), eps.alias("epsilon")]
    return x.select(*out, *([(eps >= total).alias("exhausted")] if total is not None else []))


def dp_sgd_steps(epochs: int, batch_size: int, dataset_size: int) -> tuple[int, float]:
    """Steps and sampling rate of a run."""
    return epochs * (dataset_size // batch_size), batch_size / dataset_size


def budget(total_epsilon: Column, spent: Column, total_delta: Column | None = None, spent_delta: Column | None = None) -> Column:
    """struct(remaining, ratio, exhausted), and remaining_delta if deltas are given; used up as soon as either is."""
    parts = [F.greatest(F.lit(0.0), total_epsilon - spent).alias("remaining"), F.least(F.lit(1.0), spent / total_epsilon).alias("ratio")]
    gone = total_epsilon - spent <= 0
    if total_delta is not None:
        parts.append(F.greatest(F.lit(0.0), total_delta - spent_delta).alias("remaining_delta"))
        gone = gone | (total_delta - spent_delta <= 0)
    return F.struct(*parts, gone.alias("exhausted"))


def budget_trace(log: DataFrame, key: str, order: str, total: float, floor: float = 0.0) -> DataFrame:
    """key, order, left: the budget after each entry of (key, order, spent), never below floor. Spending isn't negative, so the running sum decides."""
    over = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return log.withColumn("left", F.greatest(F.lit(floor), F.lit(total) - F.sum("spent").over(over))).select(key, order, "left")


def client_spent(rounds: Column, noise_multiplier: Column, target: Column, sample_rate: float = 0.01) -> Column:
    """struct(spent, remaining) of a client after so many rounds, each rate / noise; nulls without noise."""
    spent = F.try_divide(rounds * F.lit(sample_rate), noise_multiplier)
    return F.struct(spent.alias("spent"), F.greatest(F.lit(0.0), target - spent).alias("remaining"))


def spent_epsilon(log: DataFrame, orders_: DataFrame, kind: str = "rdp", delta: float = 1e-5) -> DataFrame:
    """(epsilon) of a log by the named accountant: rdp, gdp (its mu) or simple."""
    if kind == "rdp":
        return rdp_epsilon(rdp_per_order(log, orders_), delta)
    if kind == "gdp":
        return gdp(log).select(F.col("mu").alias("epsilon"))
    if kind == "simple":
        return simple_epsilon(log, delta)
    raise ValueError(f"unknown accountant {kind}")


def accounting_summary(log: DataFrame, orders_: DataFrame, kind: str = "rdp", target_epsilon: float = 8.0, target_delta: float = 1e-5) -> DataFrame:
    """One row: accountant, targets, spent_epsilon, steps, ratio and whether the budget is used up."""
    steps = log.groupBy().agg(F.coalesce(F.sum("steps"), F.lit(0)).alias("steps"))
    x = spent_epsilon(log, orders_, kind, target_delta).join(steps)
    spent = F.coalesce("epsilon", F.lit(0.0))
    state = budget(F.lit(target_epsilon), spent)
    return x.select(F.lit(kind).alias("accountant"), F.lit(target_epsilon).alias("target_epsilon"), F.lit(target_delta).alias("target_delta"), spent.alias("spent_epsilon"), "steps", state["ratio"].alias("ratio"), state["exhausted"].alias("exhausted"))


def run_epsilon(spark: SparkSession, runs: DataFrame, delta: float = 1e-5) -> DataFrame:
    """run, steps, epsilon of (run, epochs, batch_size, dataset_size, noise_multiplier): the reference formula for each run, all runs in one pass."""
    rate = F.col("batch_size") / F.col("dataset_size")
    n = F.col("epochs") * F.floor(F.col("dataset_size") / F.col("batch_size"))
    x = runs.select("run", n.cast("bigint").alias("steps"), rate.alias("_q"), F.col("noise_multiplier").alias("_z")).join(F.broadcast(orders(spark)))
    alpha, qz = F.col("alpha"), F.col("_q") * F.col("_z")
    # of a step; all steps of a run are alike
    rdp = F.when(alpha < 2, 0.0).otherwise(0.5 * alpha * qz * qz + F.when(alpha > 2, (alpha - 1) * F.col("_q") * qz * qz * F.col("_z") / 6).otherwise(0.0))
    x = x.withColumn("_r", rdp).withColumn("_e", F.col("_r") * alpha + math.log(delta) / (alpha - 1))
    found = F.max((F.col("_e") > 0).cast("int")) == 1
    eps = F.when(F.max("_r") == 0, 0.0).when(found, F.min_by("_e", F.when(F.col("_e") > 0, F.col("i")))).otherwise(F.col("steps") * 0.01)
    return x.groupBy("run", "steps").agg(F.when(F.col("steps") == 0, 0.0).otherwise(eps).alias("epsilon"))


def spent_by_rounds(accounting: str, sample_rate: float, noise_multiplier: float, steps: int, delta: float) -> float:
    """What so many equal rounds have spent: simple (the reference formula) or standard (the usual bound, without subsampling)."""
    if accounting == "standard":
        return standard_rdp_epsilon(noise_multiplier, steps, delta) if steps and noise_multiplier else (math.inf if steps else 0.0)
    return steps * sample_rate * noise_multiplier * math.sqrt(2 * math.log(1 / delta))
