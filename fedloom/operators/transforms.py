"""Transform coding of updates: Haar wavelets and Fourier transforms by blocks, of which the largest coefficients are kept.

Rows are group columns + (idx, value), idx from 0 on without gaps; a missing or null value counts as 0 below the
greatest coordinate of its group.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import keep_count
from ..plans.session import Scratch, ship_package
from .runs import whole_groups
from .selection import kth_largest, with_state

GROUP = ("client", "param")
HAAR_BITS = 12
DFT_BLOCK = 256
ROOT = math.sqrt(0.5)


def _kind(rows: DataFrame, group: Sequence[str]) -> str:
    kinds = dict(rows.dtypes)
    return ", ".join(f"`{g}` {kinds[g]}" for g in group)


def _by_blocks(rows: DataFrame, keys: Sequence[str], one: Callable[[pa.Table, np.ndarray, np.ndarray], tuple[np.ndarray, dict[str, np.ndarray]]], schema: str, named: Sequence[str]) -> DataFrame:
    """What `one` makes of many whole groups at once: of (rows, where groups begin and end) each result's group and the columns beside `named`."""

    def run(batches):
        for table, starts in whole_groups(batches, keys):
            group, cols = one(table, starts, np.append(starts[1:], table.num_rows))
            of = pa.array(starts[group])
            taken = {k: table.column(k).combine_chunks().take(of) for k in named} | {k: pa.array(v) for k, v in cols.items()}
            yield from pa.table(taken).to_batches(1 << 16)

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def haar_steps(x: np.ndarray, levels: int) -> tuple[list[np.ndarray], np.ndarray]:
    """(details of each level, what is left) of each row: pairs by lifting, an odd last number is carried on as it is."""
    details = []
    for _ in range(levels):
        a, b = x[..., 0::2], x[..., 1::2]
        m = b.shape[-1]
        d = (b - a[..., :m]) * -ROOT
        x = np.concatenate(((a[..., :m] + b) * ROOT, a[..., m:]), axis=-1)
        details.append(d)
    return details, x


def haar_back(details: list[np.ndarray], x: np.ndarray, sizes: list[int]) -> np.ndarray:
    """sizes: of the numbers before each level."""
    for d, n in zip(details[::-1], sizes[::-1], strict=True):
        out = np.empty((*x.shape[:-1], n))
        m = n // 2
        out[..., 0 : 2 * m : 2], out[..., 1 : 2 * m : 2] = (x[..., :m] + d) * ROOT, (x[..., :m] - d) * ROOT
        out[..., 2 * m :] = x[..., m:]
        x = out
    return x


def _passes(rows: DataFrame, bits: int) -> int:
    """How often blocks of 2^bits numbers become one until one is left."""
    most = rows.agg(F.max("idx")).first()[0] or 0
    n = 1
    while most >> (bits * n):
        n += 1
    return n


def _haar_block(bits: int, below: int) -> Callable[[pa.Table, np.ndarray, np.ndarray], tuple[np.ndarray, dict[str, np.ndarray]]]:
    """Blocks' details, whose levels come after the `below` ones of earlier passes, and what is left."""

    def block(table: pa.Table, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        idx, value = table.column("idx").to_numpy(), table.column("value").to_numpy()
        of = np.repeat(np.arange(len(starts)), ends - starts)
        first = np.minimum.reduceat(idx, starts) >> bits << bits
        size = np.maximum.reduceat(idx, starts) - first + 1
        found = []
        for n in np.unique(size).tolist():  # blocks of one length together
            mine = np.flatnonzero(size == n)
            here = size[of] == n
            v = np.zeros((len(mine), n))
            v[np.searchsorted(mine, of[here]), (idx - first[of])[here]] = value[here]
            details, left = haar_steps(v, bits)
            for level, shift, x in [*((below + k + 1, k + 1, d) for k, d in enumerate(details)), (0, bits, left)]:
                m = x.shape[1]
                found.append((np.repeat(mine, m), np.full(x.size, level, np.int32), ((first[mine] >> shift)[:, None] + np.arange(m)).ravel(), x.ravel()))
        group, *cols = (np.concatenate(x) for x in zip(*found, strict=True))
        return group, dict(zip(("level", "pos", "value"), cols, strict=True))

    return block


def haar(rows: DataFrame, group: Sequence[str] = GROUP, bits: int = HAAR_BITS) -> DataFrame:
    """group, level, pos and value: orthonormal details by level from 1 on, and, as level 0, what is left of a group.

    A pass takes blocks of 2^bits numbers through as many levels, and hands the one number that is left of each to
    the next pass. Levels are the same whatever the blocks; levels without a detail have no row.
    """
    ship_package(rows.sparkSession)
    group = list(group)
    scratch = Scratch(rows.sparkSession)
    x = rows.select(*group, F.col("idx").cast("bigint").alias("idx"), F.coalesce("value", F.lit(0.0)).cast("double").alias("value"))
    schema = f"{_kind(x, group)}, level int, pos bigint, value double"
    parts = []
    passes = _passes(x, bits)
    for p in range(passes):
        done = _by_blocks(x.withColumn("_block", F.shiftright("idx", bits)), [*group, "_block"], _haar_block(bits, p * bits), schema, group)
        done = scratch.table(done, "haar")
        parts.append(done.where("level > 0") if p + 1 < passes else done)
        x = done.where("level = 0").select(*group, F.col("pos").alias("idx"), "value")
    out = parts[0]
    for y in parts[1:]:
        out = out.union(y)
    return out


def haar_inverse(coefficients: DataFrame, sizes: DataFrame, group: Sequence[str] = GROUP, bits: int = HAAR_BITS) -> DataFrame:
    """group, idx and value from coefficients, missing ones 0; sizes has group and n, how many numbers a group has."""
    ship_package(coefficients.sparkSession)
    group = list(group)
    scratch = Scratch(coefficients.sparkSession)
    most = sizes.agg(F.max("n")).first()[0] or 0
    passes = _passes(sizes.select((F.col("n") - 1).alias("idx")), bits) if most else 1
    # a group of which nothing was kept has numbers all the same
    left = sizes.select(*group, F.lit(0).cast("bigint").alias("idx")).join(coefficients.where("level = 0").select(*group, "value"), group, "left").select(*group, "idx", F.coalesce("value", F.lit(0.0)).alias("value"))
    schema = f"{_kind(sizes, group)}, idx bigint, value double"
    for p in range(passes - 1, -1, -1):
        n = F.shiftright(F.col("n") - 1, p * bits) + 1
        level = F.col("level") - p * bits
        mine = coefficients.where((level > 0) & (level <= bits)).select(*group, F.expr(f"pos >> ({bits} - (level - {p * bits}))").alias("_block"), level.cast("int").alias("level"), "pos", "value")
        rows = mine.unionByName(left.select(*group, F.col("idx").alias("_block"), F.lit(0).alias("level"), F.col("idx").alias("pos"), "value"))
        rows = with_state(rows, sizes.select(*group, n.alias("_n")), group, F.col("_block"))

        def block(table: pa.Table, starts: np.ndarray, ends: np.ndarray, bits: int = bits) -> tuple[np.ndarray, dict[str, np.ndarray]]:
            of = np.repeat(np.arange(len(starts)), ends - starts)
            first = table.column("_block").to_numpy()[starts] << bits
            size = np.minimum(table.column("_n").to_numpy()[starts] - first, 1 << bits)
            level, pos, value = (table.column(k).to_numpy() for k in ("level", "pos", "value"))
            found = []
            for n in np.unique(size).tolist():
                mine = np.flatnonzero(size == n)
                here = [n]
                for _ in range(bits):
                    here.append(-(-here[-1] // 2))
                of_size = size[of] == n
                details = []
                for k in range(bits + 1):
                    at = np.flatnonzero(of_size & (level == (k + 1 if k < bits else 0)))
                    d = np.zeros((len(mine), here[k] // 2 if k < bits else 1))
                    d[np.searchsorted(mine, of[at]), pos[at] - (first[of[at]] >> (k + 1 if k < bits else bits))] = value[at]
                    details.append(d)
                out = haar_back(details[:-1], details[-1], here[:-1])
                found.append((np.repeat(mine, n), (first[mine, None] + np.arange(n)).ravel(), out.ravel()))
            group, idx, value = (np.concatenate(x) for x in zip(*found, strict=True))
            return group, {"idx": idx, "value": value}

        new = scratch.table(_by_blocks(rows, [*group, "_block"], block, schema, group), "haar")
        scratch.drop(left)
        left = new
    return left


def dft(rows: DataFrame, group: Sequence[str] = GROUP, block: int = DFT_BLOCK) -> DataFrame:
    """group, block, k, re, im and n: the Fourier coefficients 0 to n / 2 of each stretch of `block` coordinates, n of them in it."""
    ship_package(rows.sparkSession)
    group = list(group)
    x = rows.select(*group, F.floor(F.col("idx") / block).cast("bigint").alias("block"), (F.col("idx") % block).cast("int").alias("at"), F.coalesce("value", F.lit(0.0)).cast("double").alias("value"))

    def one(table: pa.Table, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        at, value = table.column("at").to_numpy(), table.column("value").to_numpy()
        of = np.repeat(np.arange(len(starts)), ends - starts)
        size = np.maximum.reduceat(at, starts) + 1
        found = []
        for n in np.unique(size).tolist():  # blocks of one length together
            mine = np.flatnonzero(size == n)
            here = size[of] == n
            v = np.zeros((len(mine), n))
            v[np.searchsorted(mine, of[here]), at[here]] = value[here]
            z = np.fft.rfft(v, axis=1)
            k = np.tile(np.arange(z.shape[1], dtype=np.int32), len(mine))
            found.append((np.repeat(mine, z.shape[1]), k, z.real.ravel(), z.imag.ravel(), np.full(z.size, n, np.int32)))
        group, *cols = (np.concatenate(x) for x in zip(*found, strict=True))
        return group, dict(zip(("k", "re", "im", "n"), cols, strict=True))

    return _by_blocks(x, [*group, "block"], one, f"{_kind(x, group)}, block bigint, k int, re double, im double, n int", [*group, "block"])


def dft_inverse(coefficients: DataFrame, catalog: DataFrame, group: Sequence[str] = GROUP, block: int = DFT_BLOCK) -> DataFrame:
    """group, idx and value at all coordinates of a catalogue, from coefficients (missing ones are 0)."""
    ship_package(catalog.sparkSession)
    group = list(group)
    sizes = catalog.groupBy(*group, F.floor(F.col("idx") / block).cast("bigint").alias("block")).agg((F.max(F.col("idx") % block) + 1).cast("int").alias("n"))
    rows = sizes.join(coefficients.select(*group, "block", "k", "re", "im"), [*group, "block"], "left")

    def one(table: pa.Table, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        of = np.repeat(np.arange(len(starts)), ends - starts)
        size, first = table.column("n").to_numpy()[starts], table.column("block").to_numpy()[starts] * block
        there = table.column("k").combine_chunks().is_valid().to_numpy(zero_copy_only=False)
        k, re, im = (table.column(c).combine_chunks().fill_null(0).to_numpy() for c in ("k", "re", "im"))
        found = []
        for n in np.unique(size).tolist():
            mine = np.flatnonzero(size == n)
            here = (size[of] == n) & there
            z = np.zeros((len(mine), n // 2 + 1), np.complex128)
            z[np.searchsorted(mine, of[here]), k[here]] = re[here] + 1j * im[here]
            found.append((np.repeat(mine, n), (first[mine, None] + np.arange(n)).ravel(), np.fft.irfft(z, n, axis=1).ravel()))
        group, idx, value = (np.concatenate(x) for x in zip(*found, strict=True))
        return group, {"idx": idx, "value": value}

    return _by_blocks(rows, [*group, "block"], one, f"{_kind(sizes, group)}, idx bigint, value double", group)


def largest(coefficients: DataFrame, share: float, group: Sequence[str] = GROUP, complex_: bool = False) -> DataFrame:
    """Of each group's coefficients the max(1, int(n share)) of largest magnitude; ties stay. Radix selection, so no task sees a group's coefficients together."""
    size = F.hypot("re", "im") if complex_ else F.abs("value")
    sized = coefficients.withColumn("_m", size)
    cut = kth_largest(sized.select(*group, F.col("_m").alias("value")), group, keep_count(F.col("n"), share)).withColumnRenamed("value", "_t")
    return with_state(sized, cut, group, F.col("_m")).where("_m >= _t").drop("_m", "_t")
