"""Compression, quantisation, run lengths and communication savings. Groups are (client, param) unless given."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import keep_count, uniform
from .selection import kth_largest, percentiles, with_state

GROUP = ("client", "param")


def top_k(updates: DataFrame, share: float = 0.1, group: Sequence[str] = GROUP) -> DataFrame:
    """The max(1, int(n share)) values of largest magnitude of each group; ties by coordinate."""
    over = W.partitionBy(*group)
    ranked = updates.withColumn("_k", keep_count(F.count("value").over(over), share))
    ranked = ranked.withColumn("_r", F.row_number().over(over.orderBy(F.abs("value").desc(), "idx")))
    return ranked.where("_r <= _k").drop("_r", "_k")


def top_k_global(updates: DataFrame, share: float = 0.1, by: Sequence[str] = ("client",)) -> DataFrame:
    """Values of at least the k-th largest magnitude over all parameters of a client; ties stay.

    The magnitude is found by radix selection, so no task sees a client's whole model.
    """
    sizes = updates.select(*by, F.abs("value").alias("value"))
    cut = kth_largest(sizes, by, keep_count(F.col("n"), share)).withColumnRenamed("value", "_t")
    return with_state(updates, cut, by, F.col("idx")).where(F.abs("value") >= F.col("_t")).drop("_t")


def scatter(sparse: DataFrame, catalog: DataFrame, on: Sequence[str], value: str = "value") -> DataFrame:
    """All coordinates of a catalogue, with 0 where none was kept."""
    return catalog.join(sparse, list(on), "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def random_k(updates: DataFrame, share: float = 0.1, seed: int = 0, group: Sequence[str] = GROUP) -> DataFrame:
    """k values of each group by a hash of the seed and the coordinate, with the factors that restore the norm (norm_scale) or the mean (mean_scale)."""
    over = W.partitionBy(*group)
    n = F.count("value").over(over)
    ranked = updates.withColumn("_n", n).withColumn("_k", keep_count(F.col("_n"), share)).withColumn("_s", F.sqrt(F.sum(F.col("value") * F.col("value")).over(over)))
    ranked = ranked.withColumn("_r", F.row_number().over(over.orderBy(uniform(seed, *group, "idx"), "idx")))
    kept = ranked.where("_r <= _k")
    kept = kept.withColumn("norm_scale", F.col("_s") / (F.sqrt(F.sum(F.col("value") * F.col("value")).over(over)) + 1e-10))
    return kept.withColumn("mean_scale", F.col("_n") / F.col("_k")).drop("_r", "_k", "_n", "_s")


def quantize(updates: DataFrame, levels: int = 256, group: Sequence[str] = GROUP) -> DataFrame:
    """Codes of levels even steps between a group's least and greatest value, halves to even, and the values they give back."""
    over = W.partitionBy(*group)
    out = updates.withColumn("lo", F.min("value").over(over)).withColumn("hi", F.max("value").over(over))
    span = F.col("hi") - F.col("lo")
    out = out.withColumn("code", F.rint((F.col("value") - F.col("lo")) / (span + 1e-10) * (levels - 1)).cast("int"))
    return out.withColumn("restored", F.col("lo") + F.col("code") / F.lit(levels - 1.0) * span)


def quantize_log(updates: DataFrame, levels: int = 256, group: Sequence[str] = GROUP) -> DataFrame:
    """Magnitudes quantised on a logarithmic scale; signs are kept."""
    logs = updates.withColumn("_v", F.col("value")).withColumn("value", F.log2(F.abs("value") + 1e-10))
    out = quantize(logs, levels, group)
    return out.withColumn("restored", F.pow(F.lit(2.0), "restored") * F.signum("_v")).withColumn("value", F.col("_v")).drop("_v", "lo", "hi")


def quantize_pow2(updates: DataFrame, levels: int = 8, group: Sequence[str] = GROUP, signed: bool = True) -> DataFrame:
    """The nearest of max |v| 2^-i, the first on ties; the sign is that of v > 0."""
    top = F.max(F.abs("value")).over(W.partitionBy(*group))
    out = updates.withColumn("_m", top)
    steps = F.sequence(F.lit(0), F.lit(levels - 1))
    ranked = F.transform(steps, lambda i: F.struct(F.abs(F.abs(F.col("value")) - F.col("_m") * F.pow(F.lit(0.5), i)).alias("d"), i.alias("i")))
    out = out.withColumn("code", F.array_min(ranked)["i"])
    sign = F.when(F.col("value") > 0, 1.0).otherwise(-1.0) if signed else F.lit(1.0)
    return out.withColumn("restored", F.col("_m") * F.pow(F.lit(0.5), F.col("code")) * sign).drop("_m")


def sign_compress(updates: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    """One bit (v > 0) and the mean magnitude; 0 comes back as minus that mean."""
    out = updates.withColumn("bit", (F.col("value") > 0).cast("int")).withColumn("scale", F.avg(F.abs("value")).over(W.partitionBy(*group)))
    return out.withColumn("restored", (2 * F.col("bit") - 1) * F.col("scale"))


def threshold(updates: DataFrame, least: float = 0.01, absolute: bool = True) -> DataFrame:
    v = F.abs("value") if absolute else F.col("value")
    return updates.withColumn("value", F.when(v > least, F.col("value")).otherwise(0.0))


def percentile_sparsify(updates: DataFrame, share: float = 0.1, by: Sequence[str] = ("client",)) -> DataFrame:
    """Values above the (1 - share) percentile of a client's magnitudes over all parameters; the rest become 0.

    The percentile is found by radix selection, so no task sees a client's whole model.
    """
    cut = percentiles(updates.select(*by, F.abs("value").alias("value")), by, 1 - share).withColumnRenamed("value", "_t")
    return with_state(updates, cut, by, F.col("idx")).withColumn("value", F.when(F.abs("value") > F.col("_t"), F.col("value")).otherwise(0.0)).drop("_t")


def value_frequencies(rows: DataFrame, value: str = "value") -> DataFrame:
    return rows.groupBy(value).agg(F.count("*").alias("n"))


def run_length_encode(rows: DataFrame, group: Sequence[str], order: Sequence[str], value: str = "value") -> DataFrame:
    """(group, run, value, n): maximal runs of equal consecutive values, runs counted from 1."""
    over = W.partitionBy(*group).orderBy(*order)
    change = (~F.col(value).eqNullSafe(F.lag(value).over(over)) | (F.row_number().over(over) == 1)).cast("int")
    runs = rows.withColumn("_c", change).withColumn("run", F.sum("_c").over(over.rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy(*group, "run").agg(F.first(value).alias(value), F.count("*").alias("n"))


def run_length_decode(runs: DataFrame, group: Sequence[str], value: str = "value") -> DataFrame:
    """(group, pos, value): positions count from 0."""
    over = W.partitionBy(*group).orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    at = F.coalesce(F.sum("n").over(over), F.lit(0))
    return runs.withColumn("_a", at).select(*group, F.explode(F.sequence(F.col("_a"), F.col("_a") + F.col("n") - 1)).alias("pos"), value)


def _choice(n: Column, share: float) -> Column:
    """struct(saving, order, method) of the method that saves most for n values; the first one on ties."""
    raw = (4 * n).cast("double")
    ways = [("top_k", 12 * keep_count(n, share) + 8), ("quantization", n + 16), ("sign", n + 12)]
    return F.array_max(F.array(*[F.struct((1 - size / raw).alias("saving"), F.lit(-i).alias("order"), F.lit(name).alias("method")) for i, (name, size) in enumerate(ways)]))


def method_choice(updates: DataFrame, share: float = 0.1, group: Sequence[str] = GROUP) -> DataFrame:
    """The method that saves the most bytes (float32 input, int64 positions) and what it saves; null and 0 if none saves any."""
    sizes = updates.groupBy(*group).agg(F.count("value").alias("n"))
    best = _choice(F.col("n"), share)
    return sizes.select(*group, F.when(best["saving"] > 0, best["method"]).alias("method"), F.when(best["saving"] > 0, best["saving"]).otherwise(0.0).alias("saving"))


def compress_adaptive(updates: DataFrame, share: float = 0.1, levels: int = 256, group: Sequence[str] = GROUP) -> DataFrame:
    """The rows that each group's chosen method sends, with method and restored; a group for which none saves any is sent as it is. One shuffle on the group."""
    over = W.partitionBy(*group)
    x = quantize(updates, levels, group).withColumnRenamed("restored", "_q").drop("code", "lo", "hi")
    x = sign_compress(x, group).withColumnRenamed("restored", "_s").drop("bit", "scale")
    x = x.withColumn("_n", F.count("value").over(over)).withColumn("_r", F.row_number().over(over.orderBy(F.abs("value").desc(), "idx")))
    best = _choice(F.col("_n"), share)
    x = x.withColumn("method", F.when(best["saving"] > 0, best["method"]))
    x = x.where(F.col("method").isNull() | (F.col("method") != "top_k") | (F.col("_r") <= keep_count(F.col("_n"), share)))
    value = F.when(F.col("method") == "quantization", F.col("_q")).when(F.col("method") == "sign", F.col("_s")).otherwise(F.col("value"))
    return x.withColumn("restored", value).drop("_q", "_s", "_n", "_r")


def compress(updates: DataFrame, method: str = "top_k", share: float = 0.1, levels: int | None = None, seed: int = 0, least: float = 0.01, group: Sequence[str] = GROUP) -> DataFrame:
    """The rows that a method sends, with what they give back (restored): random_k, quantization, log_quantization, sign, pow2, sparse, adaptive; any other name is top_k.

    levels: 8 for pow2 and 256 for the other quantisers unless given.
    """
    levels = levels if levels is not None else (8 if method == "pow2" else 256)
    if method == "random_k":
        return random_k(updates, share, seed, group).withColumn("restored", F.col("value") * F.col("norm_scale"))
    if method == "quantization":
        return quantize(updates, levels, group)
    if method == "log_quantization":
        return quantize_log(updates, levels, group)
    if method == "sign":
        return sign_compress(updates, group)
    if method == "pow2":
        return quantize_pow2(updates, levels, group)
    if method == "sparse":
        return threshold(updates, least).where("value <> 0").withColumn("restored", F.col("value"))
    if method == "adaptive":
        return compress_adaptive(updates, share, levels, group)
    return top_k(updates, share, group).withColumn("restored", F.col("value"))


def decompress(packed: DataFrame, catalog: DataFrame, on: Sequence[str]) -> DataFrame:
    """All coordinates of a catalogue with the values that were sent for them, 0 where none was."""
    return scatter(packed.select(*on, F.col("restored").alias("value")), catalog, on)


def sent_share(packed: DataFrame, updates: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    """group, n, sent and share: how many of a group's values a method sent. Groups of which none was sent stay."""
    n = updates.groupBy(*group).agg(F.count("*").alias("n"))
    sent = n.join(packed.groupBy(*group).agg(F.count("*").alias("sent")), list(group), "left").withColumn("sent", F.coalesce("sent", F.lit(0)))
    return sent.withColumn("share", F.col("sent") / F.col("n"))


def encode(rows: DataFrame, group: Sequence[str], order: Sequence[str], how: str = "plain", value: str = "value", piece: int = 65_536) -> DataFrame:
    """run_length: as run_length_encode; any other name: (group, piece, values), the values in order in arrays of bounded length."""
    if how == "run_length":
        return run_length_encode(rows, group, order, value)
    placed = rows.withColumn("_p", F.row_number().over(W.partitionBy(*group).orderBy(*order)) - 1).withColumn("piece", F.floor(F.col("_p") / piece))
    packed = placed.groupBy(*group, "piece").agg(F.array_sort(F.collect_list(F.struct("_p", F.col(value).alias("_v")))).alias("_a"))
    return packed.select(*group, "piece", F.transform("_a", lambda x: x["_v"]).alias("values"))


def decode(coded: DataFrame, group: Sequence[str], how: str = "plain", value: str = "value", piece: int = 65_536) -> DataFrame:
    """(group, pos, value) of what encode gave; positions count from 0."""
    if how == "run_length":
        return run_length_decode(coded, group, value)
    flat = coded.select(*group, "piece", F.posexplode("values").alias("_i", value))
    return flat.select(*group, (F.col("piece") * piece + F.col("_i")).cast("bigint").alias("pos"), value)


def update_similarity(updates: DataFrame, keys: Sequence[str] = ("client",), coordinate: Sequence[str] = ("param", "idx"), least: float = 0.95) -> DataFrame:
    """Similarity of each round's update to the client's one before, 1 - min(1, |diff| / |update|), and whether sending can be skipped. A client's first update is sent."""
    over = W.partitionBy(*keys, *coordinate).orderBy("round")
    prev = updates.withColumn("_p", F.lag("value").over(over))
    d = F.col("value") - F.col("_p")
    sums = prev.groupBy(*keys, "round").agg(
        F.sqrt(F.sum(d * d)).alias("_d"), F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("_n")
    )
    sim = F.when(F.col("_d").isNull(), None).when(F.col("_n") == 0, 1.0).otherwise(1 - F.least(F.lit(1.0), F.col("_d") / (F.col("_n") + 1e-10)))
    return sums.withColumn("similarity", sim).withColumn("skipped", F.coalesce(F.col("similarity") >= least, F.lit(False))).drop("_d", "_n")


def skip_ratio(similarity: DataFrame, keys: Sequence[str] = ("client",)) -> DataFrame:
    """Share of each client's updates that needn't be sent."""
    return similarity.groupBy(*keys).agg(F.avg(F.col("skipped").cast("double")).alias("skipped_ratio"))
