"""Linear recurrences over many rounds as a segmented parallel scan, and others as a stream of rows.

y_t = a y_(t-1) + b_t composes: over a stretch of n rounds it is an affine map with the factor a^n and, as its offset,
what the stretch gives from 0. Rounds are cut into blocks by their number; each block is a window of its own, in which
y is a sum of b_s a^(t-s). One row a block, with its offset and length, then carries y from block to block; that pass
is a stream of rows by key with one number of state. The length of a block is such that a^-n stays a moderate number.

So neither a coordinate's rounds nor its states are ever an array, and a single coordinate of any number of rounds
is still worked on by many tasks; what goes through one task is a row for each block of it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.session import ship_package

LONGEST = 4096
DIGITS = 30  # a^-n stays below 10 to this power


def block_length(factors: Sequence[float]) -> int:
    """Rounds of a block, for factors between 0 and 1 (0 needs no scan)."""
    if any(not 0 <= a <= 1 for a in factors):
        raise ValueError("factors are between 0 and 1")
    return max(1, min([LONGEST, *(int(DIGITS / -math.log10(a)) for a in factors if 0 < a < 1)]))


def streamed(rows: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], out: Sequence[str], start: Sequence[float], step: Callable[[list[float], tuple], list[float]]) -> DataFrame:
    """rows with columns `out`: after each row, in order within a key, the state that step makes of the state before and the row's columns.

    Rows are dealt and sorted by key; a task holds one state and one batch, whatever the number of rows of a key.
    """
    ship_package(rows.sparkSession)
    names = rows.columns
    keys = list(keys)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + "".join(f", {o} double" for o in out)
    begin = [float(x) for x in start]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, begin
        for batch in batches:
            marks = list(zip(*(batch.column(names.index(k)).to_pylist() for k in keys), strict=True)) if keys else [()] * batch.num_rows
            inputs = list(zip(*(batch.column(names.index(c)).to_pylist() for c in columns), strict=True))
            found = np.empty((len(out), batch.num_rows))
            for i, (mark, x) in enumerate(zip(marks, inputs, strict=True)):
                if mark != key:
                    key, state = mark, begin
                state = step(state, x)
                found[:, i] = state[: len(out)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x) for x in found)], names=[*names, *out])

    dealt = rows.repartition(*keys) if keys else rows.repartition(1)
    return dealt.sortWithinPartitions(*keys, order).mapInArrow(run, schema)


def linear_scan(rows: DataFrame, keys: Sequence[str], terms: dict[str, tuple[float, Column]], order: str = "round", length: int | None = None) -> DataFrame:
    """rows with _t, the place of each in its key's order from 1, and, for each name in terms, y = a y + b after it, from 0.

    Rows with equal order within a key have no defined place among them; b isn't null.
    """
    keys, names = list(keys), list(terms)
    factors = [a for a, _ in terms.values()]
    size = length or block_length(factors)
    x = rows.withColumn("_block", F.floor(F.col(order) / size)).select("*", *[b.cast("double").alias(f"_b_{k}") for k, (_, b) in terms.items()])
    cut = W.partitionBy(*keys, "_block").orderBy(order)
    x = x.withColumn("_i", F.row_number().over(cut))
    so_far = cut.rowsBetween(W.unboundedPreceding, 0)

    def scaled(k: str, a: float) -> Column:
        b = F.col(f"_b_{k}")
        return b if a == 0 else F.sum(b / F.pow(F.lit(a), F.col("_i"))).over(so_far) * F.pow(F.lit(a), F.col("_i"))

    x = x.select("*", *[scaled(k, a).alias(f"_y_{k}") for k, a in zip(names, factors, strict=True)])
    ends = x.groupBy(*keys, "_block").agg(F.count("*").alias("_n"), *[F.max_by(f"_y_{k}", "_i").alias(f"_y_{k}") for k in names])

    def step(state: list[float], row: tuple) -> list[float]:
        n = row[0]
        before = state[len(state) // 2 :]
        return before + [before[0] + n, *(a**n * y + o for a, y, o in zip(factors, before[1:], row[1:], strict=True))]

    # what stands before a block is what comes out, the state behind it is kept beside it
    carried = ["_before", *(f"_c_{k}" for k in names)]
    carry = streamed(ends, keys, "_block", ["_n", *(f"_y_{k}" for k in names)], carried, [0.0] * (2 * len(carried)), step)
    met = x.join(carry.select(*keys, "_block", *carried), [*keys, "_block"])
    y = [(F.col(f"_y_{k}") + F.pow(F.lit(a), F.col("_i")) * F.col(f"_c_{k}") if a else F.col(f"_y_{k}")).alias(k) for k, a in zip(names, factors, strict=True)]
    return met.select(*rows.columns, (F.col("_before") + F.col("_i")).cast("bigint").alias("_t"), *y)
