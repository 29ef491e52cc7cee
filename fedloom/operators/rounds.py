"""Client registry, sampling, metrics and vertical combination."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import ratio, uniform

DIGITS = 3  # hex digits of the pieces that cumulative weights are summed in


def active_clients(registry: DataFrame) -> DataFrame:
    """Enabled clients; a null doesn't enable one."""
    return registry.where("enabled")


def weight_shares(registry: DataFrame) -> DataFrame:
    """(client, share) of enabled clients: weight over all weights, alike if these sum to 0. The total is one row, joined back."""
    active = active_clients(registry)
    total = active.groupBy().agg(F.sum("weight").alias("_t"), F.count("*").alias("_n"))
    share = F.when(F.col("_t") == 0, 1 / F.col("_n")).otherwise(ratio("weight", "_t"))
    return active.join(F.broadcast(total)).select("client", share.alias("share"))


def default_weights(registry: DataFrame, sizes: DataFrame) -> DataFrame:
    """A client's weight where it has one above 0, else the number n of its rows in sizes, else 1."""
    known = registry.join(sizes.select("client", F.col("n").cast("double").alias("_n")), "client", "left")
    return known.withColumn("weight", F.when(F.col("weight") > 0, F.col("weight")).otherwise(F.coalesce("_n", F.lit(1.0)))).drop("_n")


def upsert(registry: DataFrame, changes: DataFrame) -> DataFrame:
    """Changed clients replace, new ones are added."""
    return registry.join(changes.select("client"), "client", "left_anti").unionByName(changes)


def remove(registry: DataFrame, clients: DataFrame) -> DataFrame:
    return registry.join(clients.select("client"), "client", "left_anti")


def sample_uniform(registry: DataFrame, k: int, seed: int) -> DataFrame:
    """k clients without replacement, by a hash of the seed and the client, so that partitions don't matter."""
    return registry.orderBy(uniform(seed, "client"), "client").limit(k)


def sample_weighted(registry: DataFrame, k: int, seed: int) -> DataFrame:
    """k clients without replacement, likelier by weight: least of -ln(u) / weight."""
    return registry.where("weight > 0").orderBy(-F.log(uniform(seed, "client")) / F.col("weight"), "client").limit(k)


def sample_with_replacement(registry: DataFrame, k: int, seed: int) -> DataFrame:
    """(draw, client): k draws, each a place on the line of cumulative weights.

    Clients stand on the line by hash. Their sums are added up in 16 ^ DIGITS pieces of it; a draw finds its piece
    in that small table and its client within the piece, so no task orders the registry.
    """
    rows = registry.where("weight > 0").select("client", "weight", F.md5(F.col("client").cast("string").cast("binary")).alias("_h")).withColumn("_p", F.substring("_h", 1, DIGITS))
    sums = rows.groupBy("_p").agg(F.sum("weight").alias("_s"))
    upto = F.sum("_s").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, 0))
    pieces = sums.withColumn("_to", upto)
    pieces = pieces.withColumn("_from", F.coalesce(F.lag("_to").over(W.orderBy("_p")), F.lit(0.0)))
    table = pieces.groupBy().agg(F.array_sort(F.collect_list(F.struct("_to", "_from", "_p"))).alias("_t"), F.max("_to").alias("_all"))
    draws = registry.sparkSession.range(k).withColumnRenamed("id", "draw").join(F.broadcast(table)).withColumn("at", uniform(seed, "draw") * F.col("_all"))
    # the first piece that ends behind the draw's place
    draws = draws.select("draw", "at", F.get(F.filter("_t", lambda x: x["_to"] > F.col("at")), F.lit(0)).alias("x")).select("draw", "x._p", (F.col("at") - F.col("x._from")).alias("at"))
    over = W.partitionBy("_p").orderBy("_h", "client").rowsBetween(W.unboundedPreceding, 0)
    line = rows.withColumn("_hi", F.sum("weight").over(over))
    met = draws.join(line, "_p").where(F.col("_hi") > F.col("at"))
    return met.groupBy("draw").agg(F.min_by("client", F.struct("_hi", "_h")).alias("client"))


def sample(registry: DataFrame, k: int, seed: int, how: str = "uniform") -> DataFrame:
    """k enabled clients by the named way: uniform, weighted or with_replacement; any other name is uniform."""
    active = active_clients(registry)
    if how == "weighted":
        return sample_weighted(active, k, seed).select("client")
    if how == "with_replacement":
        return sample_with_replacement(active, k, seed).select("client")
    return sample_uniform(active, k, seed).select("client")


def latest_updates(updates: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The last update of each key wins."""
    return updates.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order)))).where("_r = 1").drop("_r")


def quorum(updates: DataFrame, least: int) -> DataFrame:
    """Rounds with at least so many clients."""
    return updates.groupBy("round").agg(F.count_distinct("client").alias("clients")).where(F.col("clients") >= least)


def metric_means(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Plain mean of each metric over the clients that report it; rows have a map column metrics."""
    return rows.select(*keys, F.explode("metrics").alias("name", "value")).groupBy(*keys, "name").agg(F.avg("value").alias("value"))


def metrics_summary(log: DataFrame) -> DataFrame:
    """Of each name: mean, population deviation, least, greatest, latest (by ts, then seq) and count."""
    return log.groupBy("name").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.max_by("value", F.struct("ts", "seq")).alias("latest"), F.count("*").alias("n"),
    )


def experiment_summary(log: DataFrame) -> DataFrame:
    """Of each metric of (round, name, value): rounds, best (the greatest, whatever the metric) and last."""
    return log.groupBy("name").agg(F.count_distinct("round").alias("rounds"), F.max("value").alias("best"), F.max_by("value", "round").alias("last"))


def experiment_totals(history: DataFrame) -> DataFrame:
    """One row of (round, clients, seconds): rounds, clients over all rounds, and mean and whole duration; 0 without rounds."""
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return history.groupBy().agg(F.count("*").alias("rounds"), F.coalesce(F.sum("clients"), F.lit(0)).cast("bigint").alias("clients"), zero(F.avg("seconds")).alias("mean_seconds"), zero(F.sum("seconds")).alias("seconds"))


def progress(history: DataFrame, total: int) -> DataFrame:
    """One row of (round, clients, seconds): rounds done, their share of the total, mean seconds and mean clients of a round."""
    return history.groupBy().agg(F.count("*").alias("done"), (F.count("*") / F.lit(float(total))).alias("share"), F.avg("seconds").alias("avg_seconds"), F.avg("clients").alias("avg_clients"))


def classification_report(pairs: DataFrame) -> DataFrame:
    """accuracy, and precision, recall and f1 weighted by support, of (label, pred); 0 where a share has no base."""
    cells = pairs.groupBy("label", "pred").agg(F.count("*").alias("n"))
    per_label = cells.groupBy("label").agg(F.sum("n").alias("support"), F.sum(F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0)).alias("hit"))
    per_pred = cells.groupBy(F.col("pred").alias("label")).agg(F.sum("n").alias("called"))
    p = F.coalesce(F.try_divide("hit", "called"), F.lit(0.0))
    r = F.coalesce(F.try_divide("hit", "support"), F.lit(0.0))
    x = per_label.join(per_pred, "label", "left").withColumn("p", p).withColumn("r", r)
    x = x.withColumn("f", F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0)))
    n = F.sum("support")
    return x.groupBy().agg((F.sum("hit") / n).alias("accuracy"), *[(F.sum(F.col(k) * F.col("support")) / n).alias(name) for k, name in (("p", "precision"), ("r", "recall"), ("f", "f1"))])


def evaluation(rows: DataFrame) -> DataFrame:
    """classification_report of (label, pred, loss) with the mean loss of all rows; all 0 without rows."""
    loss = rows.groupBy().agg(F.avg("loss").alias("loss"))
    both = classification_report(rows).join(F.broadcast(loss))
    return both.select(*[F.coalesce(k, F.lit(0.0)).alias(k) for k in both.columns])


def extract_features(rows: DataFrame, places: Sequence[int], column: str = "features") -> DataFrame:
    """The named places (from 0) of an array column, in their order; null where the array is shorter."""
    return rows.withColumn(column, F.array(*[F.get(column, F.lit(i)) for i in places]))


def present_embeddings(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """Parties that sent an embedding."""
    return rows.where(F.col(column).isNotNull())


def combine_embeddings(rows: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(sample, dim, value): weighted over parties; the weights of absent parties count too. Without weights the plain mean."""
    if weights is None:
        return rows.groupBy("sample", "dim").agg(F.avg("value").alias("value"))
    total = weights.groupBy().agg(F.sum("w").alias("_t"))
    joined = rows.join(weights, "client").groupBy("sample", "dim").agg(F.sum(F.col("value") * F.col("w")).alias("_s"))
    return joined.join(F.broadcast(total)).select("sample", "dim", ratio("_s", "_t").alias("value"))


def aggregate_embeddings(own: DataFrame, others: DataFrame, weights: Sequence[float] | None = None) -> DataFrame:
    """(sample, dim, value): a party's own embedding and those of others, (sample, dim, place, value) with place from 1; weights by place, the own one first, alike if none are given.

    What a party lacks has no weight there.
    """
    both = own.select("sample", "dim", F.lit(0).alias("place"), "value").unionByName(others.select("sample", "dim", "place", "value"))
    w = F.get(F.array(*[F.lit(float(x)) for x in weights]), F.col("place").cast("int")) if weights else F.lit(1.0)
    return both.groupBy("sample", "dim").agg(ratio(F.sum(F.col("value") * w), F.sum(F.when(F.col("value").isNotNull(), w))).alias("value"))


def local_embedding(rows: DataFrame, keys: Sequence[str] = ("client",)) -> DataFrame:
    """Column means over a party's samples."""
    return rows.groupBy(*keys, "dim").agg(F.avg("value").alias("value"))


def feature_alignment(features: DataFrame) -> DataFrame:
    return features.groupBy("client").agg(F.array_sort(F.collect_set("feature")).alias("features"))


def feature_overlap(features: DataFrame) -> DataFrame:
    return features.groupBy().agg(F.count_distinct("feature").alias("features"), F.count_distinct("client").alias("clients"))


def align_entities(parties: Sequence[DataFrame], on: str) -> DataFrame:
    """Samples that all parties have, by an explicit key."""
    out = parties[0]
    for p in parties[1:]:
        out = out.join(p, on)
    return out
