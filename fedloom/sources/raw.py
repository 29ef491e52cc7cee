"""Weights as header-less raw bytes: float32, parameter after parameter in the order of their names, in pieces of bounded size.

Shapes come from a catalogue (param, n), as the bytes don't tell them. Where a parameter begins follows from prefix
sums over the catalogue, a row for each parameter. No model is ever one row: pieces, in order, are the file.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.selection import with_state
from ..plans.session import ship_package

PIECE = 1 << 16  # numbers of a piece
ROOM = 1 << 20  # numbers that are packed or unpacked at once


def layout(shapes: DataFrame) -> DataFrame:
    """param, n and first, the number of values before a parameter, of (param, n) in the order of names."""
    before = F.sum("n").over(W.orderBy("param").rowsBetween(W.unboundedPreceding, -1))
    return shapes.withColumn("first", F.coalesce(before, F.lit(0)).cast("bigint")).select("param", F.col("n").cast("bigint").alias("n"), "first")


def to_bytes(weights: DataFrame, shapes: DataFrame, keys: Sequence[str] = ("client",), piece: int = PIECE) -> DataFrame:
    """keys, piece and data: the file of each key in pieces of `piece` numbers. Values that are missing or null are NaN; coordinates beyond a shape are an error."""
    ship_package(weights.sparkSession)
    keys = list(keys)
    place = F.when((F.col("idx") >= 0) & (F.col("idx") < F.col("n")), F.col("first") + F.col("idx")).otherwise(F.raise_error(F.lit("a coordinate is beyond its shape")).cast("bigint"))
    at = layout(shapes)
    x = with_state(weights.select(*keys, "param", "idx", "value"), at, ["param"], F.col("idx")).select(*keys, place.alias("_at"), F.col("value").cast("float").alias("value"))
    x = x.withColumn("piece", F.floor(F.col("_at") / piece).cast("bigint"))
    total = shapes.agg(F.sum("n").cast("bigint").alias("_total"))
    # a row for every piece, so that one without values is there too; its null isn't gathered
    every = weights.select(*keys).distinct().join(F.broadcast(total)).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_total") - 1) / piece)))).where("_total > 0")
    size = F.least(F.lit(piece).cast("bigint"), F.col("_total") - F.col("piece") * piece).cast("int")
    item = F.struct((F.col("_at") - F.col("piece") * piece).cast("int").alias("at"), "value")
    rows = x.select(*keys, "piece", item.alias("x"), F.lit(None).cast("int").alias("size"))
    rows = rows.unionByName(every.select(*keys, "piece", F.lit(None).cast(rows.schema["x"].dataType).alias("x"), size.alias("size")))
    rows = rows.groupBy(*keys, "piece").agg(F.max("size").alias("size"), F.collect_list("x").alias("x"))
    kinds = dict(rows.dtypes)
    names = [*keys, "piece"]

    def pack(batches):
        for batch in batches:
            size, x = batch.column(len(names)).to_numpy().astype(np.int64), batch.column(len(names) + 1)
            n = x.value_lengths().to_numpy()
            # many small pieces are packed at once, of large ones about ROOM numbers
            ends = np.cumsum(size)
            lo = 0
            while lo < len(size):
                hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - size[lo] + ROOM, side="right")))
                begin = ends[lo:hi] - size[lo:hi] - (ends[lo] - size[lo])
                part = x.slice(lo, hi - lo).flatten()
                at, value = part.field("at").to_numpy(), part.field("value").fill_null(np.nan).to_numpy()
                out = np.full(int(size[lo:hi].sum()), np.nan, "<f4")
                out[np.repeat(begin, n[lo:hi]) + at] = value
                cut = 4 * np.append(begin, len(out))
                data = pa.Array.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(out)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(lo, hi - lo) for k in range(len(names))), data], names=[*names, "data"])
                lo = hi

    return rows.select(*names, "size", "x").mapInArrow(pack, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", piece bigint, data binary")


def from_bytes(pieces: DataFrame, shapes: DataFrame, keys: Sequence[str] = ("client",), piece: int = PIECE) -> DataFrame:
    """keys, param, idx and value of pieces that to_bytes made with the same shapes and size; a piece meets the parameters whose ranges it overlaps."""
    ship_package(pieces.sparkSession)
    keys = list(keys)
    at = layout(shapes).where("n > 0")
    ranges = at.withColumn("piece", F.explode(F.sequence(F.floor(F.col("first") / piece), F.floor((F.col("first") + F.col("n") - 1) / piece))))
    # a key's pieces have few numbers, which are those of all keys: dealt by number alone they would be in few tasks
    met = with_state(pieces, ranges, ["piece"], F.struct(*keys))
    schema = ", ".join(f"`{k}` {kind}" for k, kind in met.select(*keys).dtypes) + ", param string, _from bigint, values array<float>"
    names = met.select(*keys, "param", "piece", "first", "n", "data")

    def unpack(batches):
        for batch in batches:
            k = len(keys)
            number, first, n = (batch.column(k + j).to_numpy() for j in (1, 2, 3))
            data = batch.column(k + 4)
            size = pc.binary_length(data).to_numpy().astype(np.int64) // 4
            lo, hi = np.maximum(0, first - number * piece), np.minimum(size, first + n - number * piece)
            # as many at once as ROOM numbers hold
            ends = np.cumsum(hi - lo)
            i = 0
            while i < len(size):
                j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + ROOM, side="right")))
                raw = b"".join(data.slice(i, j - i).to_pylist())
                counts = (hi - lo)[i:j]
                cut = np.append(0, np.cumsum(counts))
                # where a row's values stand among the bytes of these pieces
                places = np.repeat(np.cumsum(size[i:j]) - size[i:j] + lo[i:j] - cut[:-1], counts) + np.arange(cut[-1])
                values = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(np.frombuffer(raw, "<f4")[places]))
                begin = pa.array((number * piece + lo - first)[i:j], pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in range(k + 1)), begin, values], names=[*keys, "param", "_from", "values"])
                i = j

    flat = names.mapInArrow(unpack, schema).select(*keys, "param", "_from", F.posexplode("values").alias("_i", "_v"))
    return flat.select(*keys, "param", (F.col("_from") + F.col("_i")).cast("int").alias("idx"), F.col("_v").alias("value"))
