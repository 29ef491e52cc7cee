"""Aggregation that withstands faulty clients: Krum, subset search and the geometric median."""

from __future__ import annotations

from collections.abc import Callable
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.session import Scratch, ship_package, work_table
from .aggregate import BY, last_rows, weighted_mean
from .distances import TILE, bound_sums, far_sums_of, gathered, pair_sums
from .subsets import CLIENTS, best_subset, rank, unrank

SUBSETS = 200_000
HELD = 1 << 20  # values of a group that one task takes through all its steps


def pairwise_distance(updates: DataFrame, tile: int = TILE, order: str | None = None) -> DataFrame:
    """(grp, a, b, dist) for a < b: Euclidean distances between the clients of a group over the coordinates of all parameters that both have; no row if they share none.

    Every pair is the operator's result. Null values are absent; of repeated rows of a coordinate the last by `order`
    counts, or that of the greatest value if no order is named.
    """
    return pair_sums(updates, tile, order=order).select("grp", "a", "b", F.sqrt("total").alias("dist"))


def krum_scores(updates: DataFrame, faulty: int = 1, order: str | None = None) -> DataFrame:
    """(grp, client, n, k, score): the sum of a client's k = n - 2 - faulty least distances to others."""
    return _scores(gathered(updates, order=order), _members(updates), faulty)


def _scores(blocks: DataFrame, members: DataFrame, faulty: int, chosen: DataFrame | None = None) -> DataFrame:
    # k leaves out no more than the faulty + 1 greatest, so a tile needs to hand over only these and one sum
    parts = far_sums_of(blocks, max(0, faulty + 1), chosen=chosen)
    found = parts.groupBy("grp", "client").agg(F.sum("m").cast("int").alias("_m"), F.flatten(F.collect_list("far")).alias("_far"), F.flatten(F.collect_list(F.array("high", "low"))).alias("_sums"))
    joined = found.join(members, "grp").withColumn("k", F.col("n") - 2 - faulty)
    out = F.greatest(F.lit(0), F.col("_m") - F.col("k")).cast("int")
    near = F.concat("_sums", F.slice(F.sort_array("_far", asc=False), out + 1, F.greatest(F.lit(0), F.size("_far") - out)))

    def add(state: Column, x: Column) -> Column:
        s = state["s"] + x
        back = s - state["s"]
        return F.struct(s.alias("s"), (state["e"] + (state["s"] - (s - back)) + (x - back)).alias("e"))

    total = F.aggregate(near, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("e")), add, lambda x: F.when(F.isnan(x["e"]), x["s"]).otherwise(x["s"] + x["e"]))
    return joined.select("grp", "client", "n", "k", F.when(F.col("k") < 1, F.lit(0.0)).otherwise(total).alias("score"))


def _score_bounds(blocks: DataFrame, members: DataFrame, faulty: int) -> DataFrame:
    """(grp, client, n, k, low, high): bounds of krum_scores. A client whose bounds aren't finite may have no score."""
    sums = bound_sums(blocks).groupBy("grp", "client").agg(F.sum("m").alias("m"), F.sum("low").alias("low"), F.sum("high").alias("high"), F.max("top").alias("top")).where("m > 0")
    sums = sums.join(members, "grp").withColumn("k", F.col("n") - 2 - faulty)
    out = F.greatest(F.lit(0), F.col("m") - F.col("k"))
    # each of the greatest distances, which don't count, is the mean at least
    low, high = F.col("low") - out * F.col("top"), F.col("high") - out * F.col("low") / F.col("m")
    finite = F.col("high") < float("inf")
    return sums.select("grp", "client", "n", "k", F.when(finite, low - F.abs(low) * 1e-9).otherwise(float("-inf")).alias("low"), F.when(finite, high + F.abs(high) * 1e-9).otherwise(float("inf")).alias("high"))


def _members(updates: DataFrame) -> DataFrame:
    """(grp, n, only): how many clients with a value a group has, and one of them."""
    return updates.where("value IS NOT NULL").groupBy("grp").agg(F.count_distinct("client").alias("n"), F.min("client").alias("only"))


def krum_survivors(updates: DataFrame, faulty: int = 1, multi: bool = True, order: str | None = None) -> DataFrame:
    """(grp, client): the one of least score, or the n - faulty - 1 of least scores; ties by client. All of a group where k < 1.

    Bounds of all scores settle most clients' places; scores are taken only of those that may be on either side of the cut.
    """
    scratch = Scratch(updates.sparkSession)
    blocks, members = scratch.table(gathered(updates, order=order), "krum-blocks"), scratch.table(_members(updates), "krum-members")
    most = F.col("n") - faulty - 1 if multi else F.lit(1)
    group, by = W.partitionBy("grp"), lambda c: W.partitionBy("grp").orderBy(c)
    # the greatest score that is kept is between the greatest of so many least bounds of either kind
    near = _score_bounds(blocks, members, faulty).withColumn("_low", F.row_number().over(by("low"))).withColumn("_high", F.row_number().over(by("high")))
    cut = lambda c: F.when(F.count("*").over(group) <= most, float("inf")).otherwise(F.max(F.when(F.col(f"_{c}") <= most, F.col(c))).over(group))
    near = near.withColumn("_from", cut("low")).withColumn("_to", cut("high"))
    sure = F.when(F.col("k") < 1, F.col("high") < float("inf")).otherwise(F.col("high") < F.col("_from"))
    near = near.withColumn("sure", sure).where("sure OR k < 1 OR low <= _to").withColumn("rest", most - F.count(F.when(F.col("sure"), 1)).over(group))
    near = scratch.table(near.select("grp", "client", "sure", "rest"), "krum-near")
    chosen, asked = near.where("sure").select("grp", "client"), near.where("NOT sure")
    if not asked.isEmpty():
        s = _scores(blocks, members, faulty, asked.select("grp", "client")).join(asked.groupBy("grp").agg(F.first("rest").alias("rest")), "grp")
        s = s.withColumn("_r", F.row_number().over(W.partitionBy("grp").orderBy("score", "client")))
        chosen = chosen.union(s.where((F.col("k") < 1) | (F.col("_r") <= F.col("rest"))).select("grp", "client"))
    alone = members.where("n = 1").select("grp", F.col("only").alias("client"))
    return chosen.union(alone)


def krum_mean(updates: DataFrame, faulty: int = 1, multi: bool = True, base: Callable[[DataFrame], DataFrame] = weighted_mean, order: str | None = None) -> DataFrame:
    """What base makes of the survivors' updates, one row of each coordinate: a defence around any aggregator."""
    rows = work_table(updates.sparkSession, last_rows(updates, order), "krum-rows")
    return base(rows.join(krum_survivors(rows, faulty, multi), ["grp", "client"], "left_semi"))


def subset_search(spark: SparkSession, updates: DataFrame, faulty: int = 1, metric: str = "variance") -> DataFrame:
    """(subset, client, score) of the clients kept: of all subsets of n - faulty clients the first of least score.

    variance: summed over coordinates; max_dist: the greatest distance within. All clients, subset -1, if there
    are fewer than 2 faulty + 1. CLIENTS clients at most; branch and bound on their distances (subsets.py). Where some
    clients lack coordinates, variances don't follow from distances: subsets are then taken one by one, by number,
    SUBSETS of them at most.
    """
    rows = last_rows(updates.withColumn("grp", F.lit(0)))
    sizes = rows.groupBy("client").agg(F.count("*").alias("n")).orderBy("client").limit(CLIENTS + 1).collect()
    ids = [r["client"] for r in sizes]
    if len(ids) < 2 * faulty + 1:
        return updates.select(F.lit(-1).alias("subset"), "client", F.lit(0.0).alias("score")).distinct()
    if len(ids) > CLIENTS:
        raise ValueError(f"more than {CLIENTS} clients")
    kind, size = updates.schema["client"].dataType.simpleString(), len(ids) - faulty
    place = {c: i for i, c in enumerate(ids)}
    d, shared = np.zeros((len(ids), len(ids))), 0
    for r in pair_sums(rows).collect():
        i, j = place[r["a"]], place[r["b"]]
        d[i, j] = d[j, i] = r["total"] ** 0.5 if metric == "max_dist" else r["total"]
        shared += r["shared"]
    n = [r["n"] for r in sizes]
    if metric != "max_dist" and not (min(n) == max(n) and shared == comb(len(ids), 2) * n[0]):
        return _each_subset(spark, rows, ids, faulty)
    cost, members = best_subset(spark, d, size, metric)
    score = cost if metric == "max_dist" else cost / size**2
    return spark.createDataFrame([(rank(members, len(ids)), ids[i], score) for i in members], f"subset bigint, client {kind}, score double").withColumn("subset", F.col("subset").cast("int" if comb(len(ids), faulty) < 1 << 31 else "bigint"))


def _each_subset(spark: SparkSession, rows: DataFrame, ids: list, faulty: int) -> DataFrame:
    """As subset_search by variance, over all subsets, which tasks make from their numbers."""
    n, size = len(ids), len(ids) - faulty
    if comb(n, faulty) > SUBSETS:
        raise ValueError(f"more than {SUBSETS} subsets of clients that lack coordinates")
    ship_package(spark)
    client = rows.schema["client"].dataType.simpleString()

    def members(batches):
        for batch in batches:
            chosen = [unrank(k, n, size) for k in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(chosen, pa.list_(pa.int32()))], names=["subset", "members"])

    table = spark.createDataFrame(list(enumerate(ids)), f"place int, client {client}")
    subsets = spark.range(comb(n, faulty)).mapInArrow(members, "subset bigint, members array<int>").select(F.col("subset").cast("int").alias("subset"), F.explode("members").alias("place"))
    subsets = subsets.join(F.broadcast(table), "place").select("subset", "client")
    scores = subsets.join(rows, "client").groupBy("subset", "param", "idx").agg(F.var_pop("value").alias("v")).groupBy("subset").agg(F.sum("v").alias("score"))
    best = scores.groupBy().agg(F.min_by(F.struct("subset", "score"), F.struct("score", "subset")).alias("x")).select("x.*")
    return subsets.join(F.broadcast(best), "subset").select("subset", "client", "score")


def subset_mean(spark: SparkSession, updates: DataFrame, faulty: int = 1, metric: str = "variance", base: Callable[[DataFrame], DataFrame] = weighted_mean) -> DataFrame:
    """What base makes of the updates of the clients that subset_search keeps."""
    return base(updates.join(subset_search(spark, updates, faulty, metric).select("client"), "client", "left_semi"))


def weiszfeld(client: np.ndarray, place: np.ndarray, value: np.ndarray, w: np.ndarray, most: int, tol: float) -> np.ndarray:
    """Steps from the weighted mean over rows of one group: client and coordinate as numbers from 0, value and weight."""
    n, m = int(client.max()) + 1, int(place.max()) + 1
    with np.errstate(invalid="ignore", divide="ignore"):
        x = np.bincount(place, value * w, m) / np.bincount(place, w, m)
        for _ in range(most):
            d = value - x[place]
            near = 1 / (np.sqrt(np.bincount(client, np.where(np.isnan(d), 0, d * d), n)) + 1e-10)[client]
            new = np.bincount(place, value * near, m) / np.bincount(place, near, m)
            if not np.sqrt(np.nansum((new - x) ** 2)) >= tol:
                break
            x = new
    return x


def geometric_median(spark: SparkSession, updates: DataFrame, most: int = 100, tol: float = 1e-6, held: int = HELD) -> DataFrame:
    """(grp, param, idx, value) by Weiszfeld steps from the weighted mean.

    A group stops when a step is shorter than tol and keeps the point before that step. Groups of `held` values at
    most take all their steps within one task each; of larger ones no task holds more than sums by client and
    coordinate (see below). Both give the same but for the order of sums. Null values are absent.
    """
    ship_package(spark)
    rows = updates.select("grp", "client", "param", "idx", F.col("value").cast("double").alias("value"), F.col("w").cast("double").alias("w")).where("value IS NOT NULL")
    scratch = Scratch(spark)
    rows = scratch.table(rows, "median-rows")
    sizes = rows.groupBy("grp").agg((F.count("*") <= held).alias("_small"))
    rows = rows.join(sizes, "grp")
    kind = rows.schema["grp"].dataType.simpleString()

    def steps(table: pa.Table) -> pa.Table:
        client = table.column("client").combine_chunks().dictionary_encode().indices.to_numpy()
        names = pa.StructArray.from_arrays([table.column(k).combine_chunks() for k in ("param", "idx")], names=["param", "idx"])
        # structs have no dictionary: parameters' numbers and coordinates make one
        param = table.column("param").combine_chunks().dictionary_encode()
        code = param.indices.fill_null(len(param.dictionary)).to_numpy().astype(np.int64)
        _, first, place = np.unique(np.stack((code, table.column("idx").to_numpy().astype(np.int64))), axis=1, return_index=True, return_inverse=True)
        x = weiszfeld(client, place.ravel(), table.column("value").to_numpy(), table.column("w").fill_null(0.0).to_numpy(), most, tol)
        named = names.take(pa.array(first))
        return pa.table({"grp": table.column("grp").combine_chunks().take(pa.array(np.zeros(len(x), np.int64))), "param": named.field("param"), "idx": named.field("idx"), "value": pa.array(x, from_pandas=True)})

    small = rows.where("_small").drop("_small").groupBy("grp").applyInArrow(steps, f"grp {kind}, param string, idx {rows.schema['idx'].dataType.simpleString()}, value double")
    small = scratch.table(small, "median-small")
    large = rows.where("NOT _small").drop("_small")
    out = small if large.isEmpty() else small.unionByName(_distributed_median(scratch, large, most, tol))
    return out


def _distributed_median(scratch: Scratch, rows: DataFrame, most: int, tol: float) -> DataFrame:
    """Each round is two aggregations of the rows, written to the shared folder; only whether any group still moves comes to the driver."""
    state = scratch.table(weighted_mean(rows).withColumn("moves", F.lit(True)), "median")
    for _ in range(most):
        now = state.where("moves").withColumnRenamed("value", "_x").drop("moves")
        met = rows.join(now, list(BY))
        far = met.groupBy("grp", "client").agg(F.sqrt(F.sum((F.col("value") - F.col("_x")) ** 2)).alias("_d"))
        near = rows.drop("w").join(far.select("grp", "client", (1 / (F.col("_d") + 1e-10)).alias("w")), ["grp", "client"])
        step = state.join(weighted_mean(near).withColumnRenamed("value", "_new"), list(BY), "left")
        size = step.groupBy("grp").agg((F.sqrt(F.sum((F.col("_new") - F.col("value")) ** 2)) >= tol).alias("_on"))
        go = F.col("moves") & F.coalesce("_on", F.lit(False))
        new = scratch.table(step.join(size, "grp").select(*BY, F.when(go, F.col("_new")).otherwise(F.col("value")).alias("value"), go.alias("moves")), "median")
        scratch.drop(state)
        state = new
        if state.where("moves").isEmpty():
            break
    return state.select(*BY, "value")
