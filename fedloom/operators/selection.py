"""Exact order statistics of large groups, by radix selection on the bits of doubles.

A double's 64 bits, flipped so that they order as the numbers do, are four digits of 16 bits. For each digit, from
the highest on, a pre-aggregated histogram tells in which of its values a wanted rank lies; only rows with that
prefix stay. No group is sorted, windowed or held anywhere: what one task sees of a group is a histogram of 65,536
rows at most. After the first digit (sign, exponent and four bits of the fraction) little of a group is left.

Groups may hold most of all rows: rows meet their group's small state by a salted join.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.session import Scratch, ship_package

DIGIT = 16
SALTS = 16


def _order_bits(x: pa.Array) -> pa.Array:
    v = x.to_numpy(zero_copy_only=False) + 0.0
    v = np.where(np.isnan(v), np.nan, v)
    bits = v.view(np.int64)
    return pa.array(np.where(bits < 0, ~bits, bits | np.int64(-(2**63))))


def order_bits(x: Column) -> Column:
    """Bits that, read as an unsigned number, order as the doubles do; -0 counts as 0, NaN is the greatest."""
    return F.arrow_udf(_order_bits, "bigint")(x)


def _from_order_bits(x: pa.Array) -> pa.Array:
    bits = x.to_numpy(zero_copy_only=False)
    return pa.array(np.where(bits < 0, bits & np.int64(2**63 - 1), ~bits).view(np.float64), from_pandas=False)


def from_order_bits(x: Column | str) -> Column:
    return F.arrow_udf(_from_order_bits, "double")(x)


def with_state(rows: DataFrame, state: DataFrame, by: Sequence[str], salt: Column) -> DataFrame:
    """Rows beside their group's few rows of state; a group's rows are dealt over SALTS tasks."""
    copies = state.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int")).join(copies, [*by, "_salt"]).drop("_salt")


def counted(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """by and n: how many values each group has."""
    return rows.groupBy(*by).agg(F.count("value").alias("n"))


def ranked_values(rows: DataFrame, by: Sequence[str], wanted: DataFrame) -> DataFrame:
    """by, want and value: of each group the value of a rank, from 1 at the least, among those that aren't null.

    wanted has by, want and rank; a rank beyond the group gives no row. Equal values take as many ranks as there are
    of them. NaN ranks last. Each digit is written, so a lost executor repeats one pass.
    """
    spark = rows.sparkSession
    ship_package(spark)
    scratch = Scratch(spark)
    by = list(by)
    bits = rows.where("value IS NOT NULL").select(*by, order_bits(F.col("value").cast("double")).alias("bits"))
    left = scratch.table(bits.groupBy(*by, "bits").agg(F.count("*").alias("n")), "radix")
    state = wanted.select(*by, "want", F.col("rank").cast("bigint").alias("rank"), F.lit(0).cast("bigint").alias("prefix"))
    for shift in range(64 - DIGIT, -1, -DIGIT):
        digit = F.shiftrightunsigned("bits", shift).bitwiseAND(F.lit((1 << DIGIT) - 1))
        counts = left.groupBy(*by, *(["prefix"] if shift < 64 - DIGIT else []), digit.alias("digit")).agg(F.sum("n").alias("n"))
        key = [*by, "prefix"] if shift < 64 - DIGIT else by
        before = F.coalesce(F.sum("n").over(W.partitionBy(*key).orderBy("digit").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        counts = counts.withColumn("before", before)
        found = (state if shift < 64 - DIGIT else state.drop("prefix")).join(counts, key)
        found = found.where((F.col("rank") > F.col("before")) & (F.col("rank") <= F.col("before") + F.col("n")))
        upper = F.shiftleft(F.col("prefix") if shift < 64 - DIGIT else F.lit(0).cast("bigint"), DIGIT)
        found = found.select(*by, "want", (F.col("rank") - F.col("before")).alias("rank"), upper.bitwiseOR(F.col("digit")).alias("prefix"))
        new_state = scratch.table(found, "radix-state")
        if shift:
            kept = with_state(left.drop("prefix").withColumn("_p", F.shiftrightunsigned("bits", shift)), new_state.select(*by, "prefix").distinct(), by, F.col("bits"))
            kept = scratch.table(kept.where("_p = prefix").drop("_p"), "radix")
            scratch.drop(left)
            left = kept
        scratch.drop(state)
        state = new_state
    out = scratch.table(state.select(*by, "want", from_order_bits("prefix").alias("value")), "radix-values")
    scratch.drop_but(out)
    return out


def percentiles(rows: DataFrame, by: Sequence[str], share: float) -> DataFrame:
    """by and value: the percentile of each group's values, between neighbours by the distance from both; no row where there is no value."""
    n = counted(rows, by).where("n > 0")
    place = (F.col("n") - 1) * F.lit(float(share))
    wanted = n.select(*by, F.explode(F.array(F.floor(place), F.ceil(place))).alias("at")).distinct().select(*by, F.col("at").alias("want"), (F.col("at") + 1).alias("rank"))
    found = ranked_values(rows, by, wanted)
    ends = found.groupBy(*by).agg(F.min_by("value", "want").alias("lo"), F.max_by("value", "want").alias("hi"), F.min("want").alias("at"))
    weight = place - F.col("at")
    # the same value on both sides stays as it is, infinite ones too
    value = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.col("lo") * (1 - weight) + F.col("hi") * weight)
    return ends.join(n, list(by)).select(*by, value.alias("value"))


def kth_largest(rows: DataFrame, by: Sequence[str], k: Column) -> DataFrame:
    """by and value: the k-th largest of each group's values; k may use n, their number."""
    wanted = counted(rows, by).select(*by, F.lit(0).alias("want"), (F.col("n") - k + 1).alias("rank"))
    return ranked_values(rows, by, wanted).select(*by, "value")
