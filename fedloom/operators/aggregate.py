"""Aggregation of updates over clients, without state.

Updates have the columns keys + (client, param, idx, value) and, where weights count, w; `by` names the columns
that one aggregate stands for, by default the group, the parameter and the coordinate within it. All are partial aggregations with one
shuffle on `by`. A null value is an absent one: neither it nor its weight counts anywhere. Repeated rows count each for itself;
last_rows leaves one of each coordinate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import c, keep_count, l2, present, ratio

BY = ("grp", "param", "idx")


def weighted_mean(updates: DataFrame, by: Sequence[str] = BY, value: str = "value", weight: Column | str = "w") -> DataFrame:
    """Sum of value times weight over the sum of weights of present values; null where these sum to 0."""
    w = present(value, weight)
    return updates.groupBy(*by).agg(ratio(F.sum(c(value) * w), F.sum(w)).alias("value"))


def last_rows(updates: DataFrame, order: str | None = None, keys: Sequence[str] = ("grp", "client", "param", "idx")) -> DataFrame:
    """One row of each key: the last by `order`, or that of the greatest value if no order is named; a null value is no row. Partial aggregation, no sort."""
    rest = [k for k in updates.columns if k not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*([order] if order else []), "value"))
    return updates.where("value IS NOT NULL").groupBy(*keys).agg(last.alias("_x")).select(*keys, "_x.*").select(*updates.columns)


def minibatch_mean(updates: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """As weighted_mean; the raw weighted sum where the weights don't sum to more than 0."""
    total, w = F.sum(F.col("value") * F.col("w")), F.sum(present("value", "w"))
    return updates.groupBy(*by).agg(F.when(w > 0, ratio(total, w)).otherwise(total).alias("value"))


def round_metrics(updates: DataFrame, group: Sequence[str] = ("grp",)) -> DataFrame:
    """group, num_clients, total_weight and avg_weight; a client counts once, with its greatest weight if it has several."""
    clients = updates.groupBy(*group, "client").agg(F.max("w").alias("w"))
    return clients.groupBy(*group).agg(F.count("*").alias("num_clients"), F.sum("w").alias("total_weight"), F.avg("w").alias("avg_weight"))


def coordinate_median(updates: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    return updates.groupBy(*by).agg(F.median("value").alias("value"))


def trimmed_mean(updates: DataFrame, share: float | None = None, faulty: int = 1, guarded: bool = True, by: Sequence[str] = BY) -> DataFrame:
    """Mean without the k least and k greatest of n values that are present, k = max(1, int(n share)), share = faulty / n if none is given.

    Weights don't count. Where n <= 2k: the plain mean if guarded, else null.
    """
    over = W.partitionBy(*by)
    n = F.count("value").over(over)
    k = keep_count(n, share) if share is not None else F.greatest(F.lit(1), F.lit(faulty)).cast("int")
    ranked = updates.withColumn("_n", n).withColumn("_k", k).withColumn("_r", F.row_number().over(over.orderBy(F.asc_nulls_last("value"), "client")))
    inside = (F.col("_r") > F.col("_k")) & (F.col("_r") <= F.col("_n") - F.col("_k"))
    kept = F.avg(F.when(inside, F.col("value")))
    return ranked.groupBy(*by).agg((F.when(F.max(F.col("_n") <= 2 * F.col("_k")), F.avg("value")).otherwise(kept) if guarded else kept).alias("value"))


def nova_weight(normalize: bool = True) -> Column:
    """Weight divided by local steps, of which one at least counts."""
    return F.col("w") / F.greatest(F.col("steps"), F.lit(1)) if normalize else F.col("w")


def toward(mean: DataFrame, globals_: DataFrame, mu: float, by: Sequence[str] = BY) -> DataFrame:
    """mean - mu (mean - global) where a global value exists."""
    g = globals_.withColumnRenamed("value", "_g")
    return mean.join(g, list(by), "left").withColumn("value", F.col("value") - mu * F.coalesce(F.col("value") - F.col("_g"), F.lit(0.0))).drop("_g")


def update_norms(updates: DataFrame, keys: Sequence[str] = ("grp", "client")) -> DataFrame:
    return updates.groupBy(*keys).agg(l2("value").alias("norm"))


def adaptive_mu(updates: DataFrame, strategy: str = "variance", layer: str | None = None) -> DataFrame:
    """mu of each group. variance: of clients' norms (summed over layers) over their mean; norm: 1 over 1 + mean norm; 1 at most."""
    if strategy == "variance":
        layers = updates.groupBy("grp", "client", *([layer] if layer else [])).agg(l2("value").alias("norm"))
        norms = layers.groupBy("grp", "client").agg(F.sum("norm").alias("norm"))
        mu = F.var_pop("norm") / (F.avg("norm") + 1e-8)
    else:
        norms, mu = update_norms(updates), 1 / (F.avg("norm") + 1)
    return norms.groupBy("grp").agg(F.least(F.lit(1.0), mu).alias("mu"))


def proximal_term(updates: DataFrame, globals_: DataFrame, mu: float, on: Sequence[str] = BY) -> DataFrame:
    """mu / 2 times the squared distance of each client's values from the global ones, over shared coordinates."""
    d = F.col("value") - F.col("_g")
    return updates.join(globals_.withColumnRenamed("value", "_g"), list(on)).groupBy("grp", "client").agg((0.5 * mu * F.sum(d * d)).alias("term"))


def hierarchical_mean(updates: DataFrame, cluster: str, by: Sequence[str] = ("param", "idx")) -> DataFrame:
    """Weighted mean within each cluster, then the plain mean of clusters."""
    inner = weighted_mean(updates, (cluster, *by))
    return inner.groupBy(*by).agg(F.avg("value").alias("value"))


def compute_delta(current: DataFrame, previous: DataFrame, on: Sequence[str]) -> DataFrame:
    return current.join(previous.withColumnRenamed("value", "_p"), list(on)).withColumn("value", F.col("value") - F.col("_p")).drop("_p")


def apply_delta(base: DataFrame, delta: DataFrame, on: Sequence[str], strict: bool = True) -> DataFrame:
    """base + delta. strict: a coordinate without a delta is an error; else it stays."""
    joined = base.join(delta.withColumnRenamed("value", "_d"), list(on), "left")
    d = F.when(F.col("_d").isNull(), F.raise_error(F.lit("a coordinate has no delta")).cast("double")).otherwise(F.col("_d")) if strict else F.coalesce("_d", F.lit(0.0))
    return joined.withColumn("value", F.col("value") + d).drop("_d")


def registry_round(updates: DataFrame, registry: DataFrame, previous: DataFrame, by: Sequence[str]) -> DataFrame:
    """previous + mean of updates, weighted as the registry says (1 for unknown clients)."""
    weighed = updates.drop("w").join(registry, "client", "left").withColumn("w", F.coalesce("w", F.lit(1.0)))
    return apply_delta(previous, weighted_mean(weighed, by), by, strict=False)


def scale_stale_values(updates: DataFrame, base: float = 0.5) -> DataFrame:
    """Values (not weights) of late updates shrink; the last update of a client wins."""
    newest = F.row_number().over(W.partitionBy("client", "param").orderBy(F.desc("round")))
    kept = updates.withColumn("_n", newest).where("_n = 1").drop("_n")
    return kept.withColumn("value", F.when(F.col("staleness") > 0, F.col("value") * F.pow(F.lit(base), F.col("staleness"))).otherwise(F.col("value")))


def drop_stale(updates: DataFrame, current_round: Column, most: int = 10) -> DataFrame:
    """With staleness as it was on arrival; updates over most rounds old go, those of later rounds stay."""
    return updates.withColumn("staleness", current_round - F.col("round")).where(F.col("staleness") <= most)
