"""Entropy coding of columns: canonical prefix codes and a range coder.

A group's symbols are the texts of its values (exact for numbers), counted in one pre-aggregated pass. The ALPHABET
most frequent ones are coded by themselves, the others behind an escape as their bytes, so a code is a small table
whatever the values are. Rows are cut into pieces by stretches of their order; each piece is coded, and decodes, on
its own. No task sees more of a group than one piece and the code.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.session import ship_package
from .selection import with_state

ALPHABET = 1 << 15
PIECE = 1 << 16
DEEPEST = 56
NULL = "\0null"
QUICK = 12
TOP, BOTTOM, WORD = 1 << 56, 1 << 48, (1 << 64) - 1


def _symbol(value: str) -> Column:
    return F.coalesce(F.col(value).cast("string"), F.lit(NULL))


def code_lengths(counts: Sequence[int]) -> list[int]:
    """Lengths of a best prefix code; a lone symbol has one bit. No longer than DEEPEST bits: counts are halved until they are."""
    n = len(counts)
    if n == 1:
        return [1]
    counts = [max(1, int(x)) for x in counts]
    while True:
        heap = [(c, i) for i, c in enumerate(counts)]
        heapq.heapify(heap)
        parent = [0] * (2 * n - 1)
        for k in range(n, 2 * n - 1):
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            parent[a[1]] = parent[b[1]] = k
            heapq.heappush(heap, (a[0] + b[0], k))
        depth = [0] * (2 * n - 1)
        for k in range(2 * n - 3, -1, -1):
            depth[k] = depth[parent[k]] + 1
        if max(depth[:n]) <= DEEPEST:
            return depth[:n]
        counts = [x // 2 + 1 for x in counts]


def canonical(lengths: Sequence[int]) -> list[int]:
    """Codes of symbols in order of (length, place): each the next number, longer by zeros."""
    code, before, out = 0, 0, [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (lengths[i], i)):
        code <<= lengths[i] - before
        before = lengths[i]
        out[i] = code
        code += 1
    return out


def code_table(rows: DataFrame, group: Sequence[str], value: str = "value", alphabet: int | None = None) -> DataFrame:
    """group, symbols, counts and lengths, as arrays of one place for each symbol: the most frequent ones by text, then, with a null symbol, the escape for all others."""
    ship_package(rows.sparkSession)
    alphabet = alphabet or ALPHABET
    group = list(group)
    n = rows.groupBy(*group, _symbol(value).alias("symbol")).agg(F.count("*").alias("n"))
    ranked = n.withColumn("_r", F.row_number().over(W.partitionBy(*group).orderBy(F.desc("n"), "symbol")))
    kept = ranked.where(F.col("_r") <= alphabet).groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("symbol", "n"))).alias("x"), F.sum("n").alias("_kept"))
    total = n.groupBy(*group).agg(F.sum("n").alias("_all"))
    rest = F.array(F.struct(F.lit(None).cast("string").alias("symbol"), (F.col("_all") - F.col("_kept")).alias("n")))
    x = F.when(F.col("_all") > F.col("_kept"), F.concat("x", rest)).otherwise(F.col("x"))
    table = kept.join(total, group).select(*group, F.transform(x, lambda s: s["symbol"]).alias("symbols"), F.transform(x, lambda s: s["n"]).alias("counts"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema.fields) + ", lengths array<int>"

    def run(batches):
        for batch in batches:
            lengths = [code_lengths(c) for c in batch.column(len(group) + 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lengths, pa.list_(pa.int32()))], names=[*batch.schema.names, "lengths"])

    return table.mapInArrow(run, schema)


def coded_bits(table: DataFrame, group: Sequence[str]) -> DataFrame:
    """group, n and bits: how long all of a group's values are as codes, what follows escapes not counted."""
    total = F.aggregate(F.zip_with("counts", "lengths", lambda c, m: c * m), F.lit(0).cast("bigint"), lambda s, v: s + v)
    n = F.aggregate("counts", F.lit(0).cast("bigint"), lambda s, v: s + v)
    return table.select(*group, n.alias("n"), total.alias("bits"))


def pack(symbols: Sequence[str], table: dict[str | None, tuple[int, int]]) -> bytes:
    """Codes one after the other, the first bit of a byte its highest; behind an escape 32 bits of length and the symbol's bytes."""
    escape = table.get(None)
    codes, lengths = [], []
    for s in symbols:
        found = table.get(s)
        if found:
            codes.append(found[0])
            lengths.append(found[1])
        else:
            raw = s.encode()
            codes += [escape[0], len(raw), *raw]
            lengths += [escape[1], 32, *[8] * len(raw)]
    code, length = np.array(codes, np.uint64), np.array(lengths, np.int64)
    at = np.repeat(np.cumsum(length) - length, length)
    place = np.arange(int(length.sum())) - at
    bits = np.repeat(code, length) >> (np.repeat(length, length) - 1 - place).astype(np.uint64) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8)).tobytes()


class PrefixReader:
    """Decoder of a canonical code."""

    def __init__(self, symbols: Sequence[str | None], lengths: Sequence[int]):
        codes = canonical(lengths)
        self.exact = {(m, c): s for s, m, c in zip(symbols, lengths, codes, strict=True)}
        self.longest = max(lengths)
        self.quick: list[tuple[str | None, int] | None] = [None] * (1 << QUICK)
        for s, m, c in zip(symbols, lengths, codes, strict=True):
            if m <= QUICK:
                self.quick[c << QUICK - m : c + 1 << QUICK - m] = [(s, m)] * (1 << QUICK - m)

    def read(self, raw: bytes, n: int) -> list[str]:
        out, at = [], 0
        raw = raw + bytes(16)

        def take(bits: int) -> int:
            nonlocal at
            lo = at >> 3
            x = int.from_bytes(raw[lo : lo + (bits + 14 >> 3)], "big")
            x >>= 8 * (bits + 14 >> 3) - (at & 7) - bits
            at += bits
            return x & (1 << bits) - 1

        while len(out) < n:
            found = self.quick[take(QUICK)]
            at -= QUICK
            if found is None:
                for m in range(QUICK + 1, self.longest + 1):
                    c = take(m)
                    if (m, c) in self.exact:
                        found = self.exact[m, c], 0
                        break
                    at -= m
            symbol, m = found
            at += m
            out.append(symbol if symbol is not None else bytes(take(8) for _ in range(take(32))).decode())
        return out


class RangeWriter:
    """Carry-less range coder with one state of 64 bits."""

    def __init__(self):
        self.low, self.range, self.out = 0, WORD, bytearray()

    def put(self, begin: int, count: int, total: int) -> None:
        self.range //= total
        self.low = self.low + begin * self.range & WORD
        self.range *= count
        while self.low ^ self.low + self.range & WORD < TOP or self.range < BOTTOM:
            if self.low ^ self.low + self.range & WORD >= TOP:
                self.range = -self.low & BOTTOM - 1
            self.out.append(self.low >> 56)
            self.low = self.low << 8 & WORD
            self.range = self.range << 8 & WORD

    def end(self) -> bytes:
        return bytes(self.out) + self.low.to_bytes(8, "big")


class RangeReader:
    def __init__(self, raw: bytes):
        self.raw, self.at, self.low, self.range = raw + bytes(16), 8, 0, WORD
        self.code = int.from_bytes(self.raw[:8], "big")

    def get(self, total: int) -> int:
        self.range //= total
        return min((self.code - self.low & WORD) // self.range, total - 1)

    def took(self, begin: int, count: int) -> None:
        self.low = self.low + begin * self.range & WORD
        self.range *= count
        while self.low ^ self.low + self.range & WORD < TOP or self.range < BOTTOM:
            if self.low ^ self.low + self.range & WORD >= TOP:
                self.range = -self.low & BOTTOM - 1
            self.code = (self.code << 8 | self.raw[self.at]) & WORD
            self.at += 1
            self.low = self.low << 8 & WORD
            self.range = self.range << 8 & WORD


def range_write(symbols: Sequence[str], known: Sequence[str | None], counts: Sequence[int]) -> bytes:
    begin = np.concatenate(([0], np.cumsum(counts))).tolist()
    place = {s: i for i, s in enumerate(known)}
    total, w = begin[-1], RangeWriter()
    for s in symbols:
        i = place.get(s, place.get(None))
        w.put(begin[i], counts[i], total)
        if s not in place:
            raw = s.encode()
            for x in (*len(raw).to_bytes(4, "big"), *raw):
                w.put(x, 1, 256)
    return w.end()


def range_read(raw: bytes, n: int, known: Sequence[str | None], counts: Sequence[int]) -> list[str]:
    begin = np.concatenate(([0], np.cumsum(counts)))
    total, r, out = int(begin[-1]), RangeReader(raw), []
    starts = begin.tolist()

    def byte() -> int:
        x = r.get(256)
        r.took(x, 1)
        return x

    for _ in range(n):
        i = int(np.searchsorted(begin, r.get(total), side="right")) - 1
        r.took(starts[i], counts[i])
        if known[i] is None:
            size = int.from_bytes(bytes(byte() for _ in range(4)), "big")
            out.append(bytes(byte() for _ in range(size)).decode())
        else:
            out.append(known[i])
    return out


def entropy_encode(rows: DataFrame, table: DataFrame, group: Sequence[str], order: str, how: str = "huffman", value: str = "value", piece: int = PIECE) -> DataFrame:
    """group, piece, n and data: the values of each stretch of `piece` numbers of the order, an integer, as one binary.

    A stretch has PIECE numbers at most, whatever `piece` is: no task holds a group.
    how: huffman or arithmetic. Null values are symbols too; rows of one order have no defined place among them.
    """
    if how not in ("huffman", "arithmetic"):
        raise ValueError(f"unknown coder {how}")
    ship_package(rows.sparkSession)
    group, piece = list(group), min(piece, PIECE)
    x = rows.select(*group, F.floor(F.col(order) / piece).cast("bigint").alias("piece"), F.struct(F.col(order).alias("o"), _symbol(value).alias("s")).alias("x"))
    pieces = x.groupBy(*group, "piece").agg(F.array_sort(F.collect_list("x")).alias("x")).select(*group, "piece", F.transform("x", lambda s: s["s"]).alias("values"))
    met = with_state(pieces, table, group, F.col("piece")).select(*group, "piece", "values", "symbols", "counts", "lengths")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in met.schema.fields[: len(group) + 1]) + ", n bigint, data binary"

    def run(batches):
        for batch in batches:
            n, data = [], []
            for k in range(batch.num_rows):
                values, symbols, counts, lengths = (batch.column(len(group) + j)[k].as_py() for j in (1, 2, 3, 4))
                n.append(len(values))
                if how == "arithmetic":
                    data.append(range_write(values, symbols, counts))
                else:
                    data.append(pack(values, dict(zip(symbols, zip(canonical(lengths), lengths, strict=True), strict=True))))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(group) + 1], pa.array(n, pa.int64()), pa.array(data, pa.binary())], names=[*batch.schema.names[: len(group) + 1], "n", "data"])

    return met.mapInArrow(run, schema)


def entropy_decode(coded: DataFrame, table: DataFrame, group: Sequence[str], how: str = "huffman", value: str = "value", kind: str = "double") -> DataFrame:
    """group, pos and value of what entropy_encode gave; positions count from 0 in each group. kind is the values' type."""
    ship_package(coded.sparkSession)
    group = list(group)
    # numbers before a piece: a row for each piece
    before = F.coalesce(F.sum("n").over(W.partitionBy(*group).orderBy("piece").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("bigint")
    starts = coded.select(*group, "piece", "n").withColumn("_at", before).drop("n")
    met = with_state(coded.join(starts, [*group, "piece"]), table, group, F.col("piece")).select(*group, "_at", "n", "data", "symbols", "counts", "lengths")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in met.schema.fields[: len(group) + 1]) + ", values array<string>"

    def run(batches):
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                n, data, symbols, counts, lengths = (batch.column(len(group) + j)[k].as_py() for j in (1, 2, 3, 4, 5))
                out.append(range_read(data, n, symbols, counts) if how == "arithmetic" else PrefixReader(symbols, lengths).read(data, n))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(group) + 1], pa.array(out, pa.list_(pa.string()))], names=[*batch.schema.names[: len(group) + 1], "values"])

    flat = met.mapInArrow(run, schema).select(*group, "_at", F.posexplode("values").alias("_i", "_s"))
    return flat.select(*group, (F.col("_at") + F.col("_i")).cast("bigint").alias("pos"), F.when(F.col("_s") != NULL, F.col("_s").cast(kind)).alias(value))
