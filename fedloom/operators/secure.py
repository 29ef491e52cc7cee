"""Secure aggregation in the field of P = 2^61 - 1, in DECIMAL(38,0), reduced after each step.

Masks and coefficients come from a hash; they show the arithmetic and are no cryptography.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.session import ship_package, work_table

P = (1 << 61) - 1
SCALE = 1_000_000
_D = "decimal(38,0)"


def field(x: Column) -> Column:
    return F.pmod(x.cast(_D), F.lit(P).cast(_D))


def encode(value: Column) -> Column:
    """Fixed point, truncated to six places."""
    return field((value * SCALE).cast("bigint"))


def decode(x: Column) -> Column:
    """Upper half of the field: negative numbers."""
    return F.when(x > P // 2, x - F.lit(P).cast(_D)).otherwise(x).cast("double") / SCALE


def coefficient(seed: int, degree: int, *keys: str) -> Column:
    return field(F.xxhash64(F.lit(seed), F.lit(degree), *keys))


def share(rows: DataFrame, threshold: int, shares: int, seed: int, keys: tuple[str, ...], secret: str = "secret") -> DataFrame:
    """keys, x and y for x = 1 to shares: a polynomial of degree threshold - 1 with the secret at 0 (Horner)."""
    x = F.col("x").cast(_D)
    acc = coefficient(seed, threshold - 1, *keys) if threshold > 1 else F.col(secret).cast(_D)
    for d in range(threshold - 2, -1, -1):
        lower = coefficient(seed, d, *keys) if d else F.col(secret).cast(_D)
        acc = field(acc * x + lower)
    return rows.withColumn("x", F.explode(F.sequence(F.lit(1), F.lit(shares)))).select(*keys, "x", acc.alias("y"))


def lagrange(xs: list[int]) -> dict[int, int]:
    """Weights at 0 of the points xs."""
    out = {}
    for i in xs:
        num = den = 1
        for j in xs:
            if j != i:
                num, den = num * -j % P, den * (i - j) % P
        out[i] = num * pow(den, -1, P) % P
    return out


def reconstruct(shares: DataFrame, xs: list[int], threshold: int, keys: tuple[str, ...]) -> DataFrame:
    """keys and secret from the shares at the first threshold of xs."""
    if len(xs) < threshold:
        raise ValueError("too few shares")
    weights = lagrange(xs[:threshold])
    w = F.lit(None).cast(_D)
    for x, v in weights.items():
        w = F.when(F.col("x") == x, F.lit(v).cast(_D)).otherwise(w)
    terms = shares.where(F.col("x").isin(list(weights))).withColumn("_t", field(F.col("y") * w))
    return terms.groupBy(*keys).agg(field(F.sum("_t")).alias("secret"))


def _double_bits(x: pa.Array) -> pa.Array:
    return pa.array(x.to_numpy(zero_copy_only=False).view(np.int64))


def _bits_double(x: pa.Array) -> pa.Array:
    return pa.array(x.to_numpy(zero_copy_only=False).view(np.float64), from_pandas=False)


def limbs(values: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, limb and secret: a double's 64 bits as two limbs of 32, each below the field's prime. Null values have none."""
    ship_package(values.sparkSession)
    bits = values.where("value IS NOT NULL").select(*keys, F.arrow_udf(_double_bits, "bigint")(F.col("value").cast("double")).alias("_b"))
    low = F.lit((1 << 32) - 1)
    parts = F.array(F.struct(F.lit(0).alias("limb"), F.col("_b").bitwiseAND(low).alias("v")), F.struct(F.lit(1).alias("limb"), F.shiftrightunsigned("_b", 32).alias("v")))
    return bits.select(*keys, F.explode(parts).alias("x")).select(*keys, "x.limb", F.col("x.v").cast(_D).alias("secret"))


def share_doubles(values: DataFrame, threshold: int, shares: int, seed: int, keys: tuple[str, ...]) -> DataFrame:
    """keys, limb, x and y: shares of the exact bits of doubles. Nothing can be added up in this form; fixed point (encode) is for sums."""
    return share(limbs(values, keys), threshold, shares, seed, (*keys, "limb"))


def reconstruct_doubles(shares: DataFrame, xs: list[int], threshold: int, keys: tuple[str, ...]) -> DataFrame:
    """keys and value, bit by bit what was shared: NaN, infinities and the negative zero too."""
    ship_package(shares.sparkSession)
    found = reconstruct(shares, xs, threshold, (*keys, "limb"))
    limb = lambda k: F.max(F.when(F.col("limb") == k, F.col("secret"))).cast("bigint")
    whole = found.groupBy(*keys).agg(F.shiftleft(limb(1), 32).bitwiseOR(limb(0)).alias("_b"))
    return whole.select(*keys, F.arrow_udf(_bits_double, "double")("_b").alias("value"))


def shared_sum(shares: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Shares of the sum over clients: added point by point."""
    return shares.groupBy(*keys, "x").agg(field(F.sum("y")).alias("y"))


def masked(values: DataFrame, clients: DataFrame, seed: int, neighbours: int = 8) -> DataFrame:
    """(client, param, idx, masked): each encoded value plus its client's masks, which cancel in the sum over clients.

    Clients stand in a ring by hash; each shares a mask with the next `neighbours` ones (with all if there are no
    more): + at the first, - at the second. Places in the ring come from counts of 16 ^ 3 pieces of it, so no task
    orders all clients, and the ring is written once. Masks come from the pair, the parameter and the coordinate, so a
    value's masks are made where the value is: rows grow with values alone. All clients must have the same coordinates.
    """
    spark = values.sparkSession
    rows = clients.select("client").distinct().withColumn("_h", F.md5(F.col("client").cast("string").cast("binary"))).withColumn("_p", F.substring("_h", 1, 3))
    rows = work_table(spark, rows, "ring-clients")
    sums = rows.groupBy("_p").agg(F.count("*").alias("_k"))
    line = W.orderBy("_p")  # over the pieces, whose number is fixed
    sums = sums.select("_p", (F.sum("_k").over(line) - F.col("_k")).alias("_before"))
    ring = rows.join(sums, "_p").withColumn("_r", F.col("_before") + F.row_number().over(W.partitionBy("_p").orderBy("_h", "client")) - 1).select("client", "_r")
    ring = work_table(spark, ring, "ring")
    n = ring.groupBy().agg(F.count("*").cast("int").alias("_n"))
    steps = F.sequence(F.lit(1), F.least(F.lit(neighbours), F.col("_n") - 1))
    pairs = ring.join(F.broadcast(n)).where("_n > 1").select(F.col("client").alias("i"), F.explode(F.transform(steps, lambda d: (F.col("_r") + d) % F.col("_n"))).alias("_r"))
    pairs = pairs.join(ring.withColumnRenamed("client", "j"), "_r").select("i", "j")
    sides = pairs.select(F.col("i").alias("client"), "i", "j", F.lit(1).alias("sign")).union(pairs.select("j", "i", "j", F.lit(-1)))
    met = sides.groupBy("client").agg(F.collect_list(F.struct("i", "j", "sign")).alias("_m"))
    zero = F.lit(0).cast(_D)
    mask = F.aggregate(F.coalesce("_m", F.array()), zero, lambda acc, x: field(acc + x["sign"] * field(F.xxhash64(F.lit(seed), x["i"], x["j"], "param", "idx"))))
    return values.join(met, "client", "left").select("client", "param", "idx", field(encode(F.col("value")) + mask).alias("masked"))


def client_masks(coordinates: DataFrame, seed: int) -> DataFrame:
    """(client, param, idx, mask): a number of the field for each coordinate of a client, by a hash of the seed and both; the same seed gives the same mask."""
    return coordinates.select("client", "param", "idx", coefficient(seed, 0, "client", "param", "idx").alias("mask"))


def commitment(values: DataFrame, by: tuple[str, ...], places: int | None = None) -> DataFrame:
    """SHA-256 of the values by parameter and coordinate, joined by commas; as many places of each as given, all of them (the shortest text that gives the number back) if none are."""
    named = values if "param" in values.columns else values.withColumn("param", F.lit(None).cast("string"))
    rows = named.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("param", "idx", "value"))).alias("_v"))
    if places is None:
        text = F.transform("_v", lambda x: F.concat_ws("=", F.coalesce(x["param"], F.lit("")), x["idx"].cast("string"), x["value"].cast("string")))
    else:
        text = F.transform("_v", lambda x: F.format_string("%d", F.round(x["value"] * 10**places).cast("bigint")))
    return rows.select(*by, F.sha2(F.array_join(text, ","), 256).alias("commitment"))


def verify(commitments: DataFrame, values: DataFrame, by: tuple[str, ...], places: int | None = None) -> DataFrame:
    """by and valid: whether the values are those committed to; false where no value or no commitment is there."""
    found = commitment(values, by, places).withColumnRenamed("commitment", "_c")
    return commitments.join(found, list(by), "full").select(*by, F.coalesce(F.col("commitment") == F.col("_c"), F.lit(False)).alias("valid"))


def default_threshold(clients: int) -> int:
    return 2 * clients // 3
