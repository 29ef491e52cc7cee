"""Distances between all clients of a group, by blocks of coordinates.

A block is a stretch of WIDTH coordinates of one parameter, a tile about TILE clients of a group. A group's tiles are
dealt into PARTS parts, and a cell gets the blocks of two parts. It takes its pairs of tiles one after the other and
adds up their blocks, in their order, in matrices of a row for each client of the first tile: sums of squared
differences and numbers of shared coordinates. What is asked of the pairs is made there: pairs themselves are never
shuffled, and what is shuffled grows as the input does. A cell has HELD bytes in memory, and the rest in a local file. Differences are squared, not built from dot
products and norms: for clients that are nearly equal the latter lose all digits. Where only an order of sums is asked for,
dot products in short floats give bounds of each sum first (`bound_sums`), with all that rounding can do, and squared
differences are taken of the clients alone whose bounds don't settle their place.
"""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import ship_package
from .runs import whole_groups

TILE = 2048
WIDTH = 256
ROWS = 64  # of the first tile that are compared at once with all of the second
PARTS = 4  # of a group's tiles
HELD = 1 << 26  # bytes of a cell's blocks in memory
MOST = 1 << 16  # pairs that are handed over at once
COLUMNS = 1024  # coordinates whose dot products are taken at once
STRIP, PIECE = 256, 32  # rows of dot products, and of their square roots, at once
PATTERNS = 1 << 12  # stretches of coordinates that a cell tells apart by who has them
SHORT = 2.0**-24  # what rounding to a short float changes at most


def _stretch(places: np.ndarray) -> slice | np.ndarray:
    return slice(places[0], places[-1] + 1) if places[-1] - places[0] + 1 == len(places) else places


def add_block(total: np.ndarray, shared: np.ndarray, at: np.ndarray, a: np.ndarray, met: np.ndarray, b: np.ndarray, same: bool) -> None:
    """Add a block's squared differences and shared coordinates, of rows a and b that have the ascending places `at` and `met`; NaN is absent.

    Coordinates are added one after the other, so that equal clients have equal sums; what one of both lacks adds 0. same: of a tile with itself only pairs of ascending places.
    """
    a_has, b_has = ~np.isnan(a), ~np.isnan(b)
    finite = np.isfinite(a[a_has]).all() and np.isfinite(b[b_has]).all()
    to = _stretch(met)
    if not isinstance(to, slice):
        # all places of the second tile, so that whole rows are added
        wide, wide_has = np.zeros((total.shape[1], b.shape[1])), np.zeros((total.shape[1], b.shape[1]), bool)
        wide[met], wide_has[met] = b, b_has
        b, b_has, to = wide, wide_has, slice(0, total.shape[1])
    y, y_has = np.ascontiguousarray(np.where(b_has, b, 0.0).T), np.ascontiguousarray(b_has.T)
    x, width = np.where(a_has, a, 0.0), y.shape[1]
    whole = a_has.all(0), y_has.all(1)
    rows = ROWS if whole[0].all() and whole[1].all() else max(1, ROWS // 4)
    y_met, d = y_has.astype(np.float32), None
    for lo in range(0, len(at), rows):
        of = _stretch(at[lo : lo + rows])
        begin = max(0, int(at[lo]) - to.start) if same else 0
        place = of, slice(to.start + begin, to.stop)
        sums, x_has = total[place], a_has[lo : lo + rows]
        d = d if d is not None and d.shape == sums.shape else np.empty((len(x_has), width - begin))
        for k in range(x.shape[1]):
            np.subtract(x[lo : lo + rows, k, None], y[k, begin:], out=d)
            for have, all_have in ((y_has[k, begin:], whole[1][k]), (x_has[:, k, None], whole[0][k])):
                if not all_have and finite:
                    d *= have
                elif not all_have:
                    d[~np.broadcast_to(have, d.shape)] = 0.0
            sums += np.multiply(d, d, out=d)
        if not isinstance(of, slice):
            total[place] = sums
        shared[place] += x.shape[1] if rows == ROWS else (x_has.astype(np.float32) @ y_met[:, begin:]).astype(shared.dtype)


class Cell:
    """The blocks of two parts of a group's tiles (or of one part). Beyond HELD bytes they are in a file without a name, and read one at a time."""

    def __init__(self, same: bool):
        self.same = same
        self.places: tuple[dict, dict] = ({}, {})  # of each side: tile -> client -> place
        self.blocks: dict = {}  # tile -> block -> (places, coordinates, values) or where in the file these are
        self.size, self.file = 0, None

    def add(self, first: bool, tile: int, block: tuple, clients: list, coords: np.ndarray, x: np.ndarray) -> None:
        """A tile's block: a row of x for each client, a column for each coordinate; NaN is absent."""
        known = self.places[0 if first or self.same else 1].setdefault(tile, {})
        places = np.array([known.setdefault(c, len(known)) for c in clients], np.int64)
        order = np.argsort(places)
        found = places[order], coords, x[order]
        self.size += x.nbytes
        if self.size > HELD:
            self.file = self.file or tempfile.TemporaryFile()
            at = self.file.seek(0, 2)
            pickle.dump(found, self.file, protocol=5)
            found = at
        self.blocks.setdefault(tile, {})[block] = found

    def _read(self, tile: int, block: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = self.blocks[tile][block]
        if isinstance(found, int):
            self.file.seek(found)
            return pickle.load(self.file)
        return found

    def pairs(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Of each pair of tiles both, the sums and the numbers of shared coordinates, a row for each client of the first; of a tile with itself only what is above the diagonal counts."""
        rows, columns = self.places[0], self.places[0 if self.same else 1]
        for a in rows:
            for b in columns:
                if self.same and b < a:
                    continue
                size = len(rows[a]), len(columns[b])
                total, shared = np.zeros(size), np.zeros(size, np.int32)
                for block in self.blocks[a]:
                    if block not in self.blocks[b]:
                        continue
                    at, coords, x = self._read(a, block)
                    if a == b:
                        add_block(total, shared, at, x, at, x, True)
                        continue
                    met, others, y = self._read(b, block)
                    if not np.array_equal(coords, others):
                        _, i, j = np.intersect1d(coords, others, assume_unique=True, return_indices=True)
                        x, y = x[:, i], y[:, j]
                    if x.shape[1]:
                        add_block(total, shared, at, x, met, y, False)
                yield a, b, total, np.triu(shared, 1) if a == b else shared


class Layout:
    """The columns of a cell's dot products: a block's coordinates about their mean, and stretches of coordinates that the same clients have. As short floats after division by a power of two."""

    def __init__(self, cell: Cell):
        self.cell, self.scale, self.bounded = cell, 1.0, True
        found: dict = {}  # block -> (coordinates, sums, numbers of values)
        largest = 0.0
        for tile, blocks in cell.blocks.items():
            for block in blocks:
                _, coords, x = cell._read(tile, block)
                has = ~np.isnan(x)
                v = np.where(has, x, 0.0)
                top = np.abs(v).max(initial=0.0)
                if not top < 1e150:
                    self.bounded = False
                    return
                largest = max(largest, float(top))
                known, sums, n = found.get(block, (coords, 0.0, 0))
                if not np.array_equal(known, coords):
                    both = np.union1d(known, coords)
                    sums, n = (self._wide(both, c, y) for c, y in ((known, sums), (known, n)))
                    found[block] = both, sums + self._wide(both, coords, v.sum(0)), n + self._wide(both, coords, has.sum(0))
                else:
                    found[block] = known, sums + v.sum(0), n + has.sum(0)
        self.scale = 2.0 ** (np.frexp(largest)[1] + 1) if largest > 0 else 1.0
        self.blocks = {k: (coords, sums / np.maximum(n, 1)) for k, (coords, sums, n) in sorted(found.items(), key=lambda e: str(e[0])) if len(coords)}
        tiles = {t: side for side in cell.places for t, side in side.items()}
        self.sizes = {t: len(places) for t, places in tiles.items()}
        # where another stretch begins, and whether there is a coordinate that all clients have
        changes = {k: np.zeros(max(0, len(coords) - 1), bool) for k, (coords, _) in self.blocks.items()}
        complete: dict = {}
        for tile, blocks in cell.blocks.items():
            for block in blocks:
                if block not in self.blocks:
                    continue
                _, has = self._values(tile, block)
                changes[block] |= (has[:, 1:] != has[:, :-1]).any(0)
                complete[block] = complete.get(block, 0) + (has.all(0) & (len(has) == self.sizes[tile]))
        self.everyone = any((n == len(tiles)).any() for n in complete.values())
        self.begins = {k: np.append(0, np.flatnonzero(c) + 1) for k, c in changes.items()}
        self.chunks: list[list] = [[]]
        size = self.width = 0
        for k, (coords, _) in self.blocks.items():
            columns = len(coords) + 2 * len(self.begins[k])
            if size and size + columns > COLUMNS:
                self.chunks.append([])
                size = 0
            self.chunks[-1].append(k)
            size += columns
            self.width = max(self.width, size)
        self.bounded = self.everyone or 0 < sum(map(len, self.begins.values())) <= PATTERNS
        self.keep = len(self.chunks) == 1 and 8 * self.width * sum(self.sizes.values()) <= HELD
        self.held: dict = {}
        if self.bounded:
            self.tiles = {t: self._tile(t) for t in tiles}

    @staticmethod
    def _wide(both: np.ndarray, coords: np.ndarray, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(both), x.dtype)
        out[np.searchsorted(both, coords)] = x
        return out

    def _values(self, tile: int, block: tuple) -> tuple[np.ndarray, np.ndarray]:
        """Differences to the block's means, 0 where there is no value, and which there are, of all the block's coordinates."""
        places, coords, x = self.cell._read(tile, block)
        known, mean = self.blocks[block]
        if len(coords) != len(known):
            y = np.full((len(x), len(known)), np.nan)
            y[:, np.searchsorted(known, coords)] = x
            x = y
        has = ~np.isnan(x)
        return np.where(has, (x - mean) / self.scale, 0.0), has

    def _tile(self, tile: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each client its squared norm and the number of its pattern, that is which stretches it has; the patterns, eight stretches a byte, and how many clients have them."""
        norm = np.zeros(self.sizes[tile])
        has = np.zeros((self.sizes[tile], 0 if self.everyone else sum(map(len, self.begins.values()))), bool)
        at = 0
        for block, begins in self.begins.items():
            if block in self.cell.blocks[tile]:
                places = self.cell._read(tile, block)[0]
                z, there = self._values(tile, block)
                norm[places] += (z * z).sum(1)
                if not self.everyone:
                    has[places, at : at + len(begins)] = there[:, begins]
            at += len(begins)
        patterns, of, n = np.unique(np.packbits(has, axis=1), axis=0, return_inverse=True, return_counts=True)
        return norm, of.ravel(), patterns, n

    def columns(self, tile: int, chunk: int) -> tuple[np.ndarray, np.ndarray]:
        """A row for each client: left and right factors whose product is the sum of squared differences over the chunk's shared coordinates."""
        if (tile, chunk) in self.held:
            return self.held[tile, chunk]
        left = []
        right = []
        for block in self.chunks[chunk]:
            begins = self.begins[block]
            z_all, n_all, h_all = (np.zeros((self.sizes[tile], k), np.float32) for k in (len(self.blocks[block][0]), len(begins), len(begins)))
            if block in self.cell.blocks[tile]:
                places = self.cell._read(tile, block)[0]
                z, has = self._values(tile, block)
                z_all[places], n_all[places], h_all[places] = z, np.add.reduceat(z * z, begins, axis=1), has[:, begins]
            left += [z_all, n_all, h_all]
            right += [-2 * z_all, h_all, n_all]
        out = np.concatenate(left, 1), np.concatenate(right, 1)
        if self.keep:
            self.held[tile, chunk] = out
        return out

    def meets(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """With how many clients of the other tile, or others of the same, each client of a and of b shares coordinates."""
        if self.everyone:
            return np.full(self.sizes[a], self.sizes[b] - (a == b)), np.full(self.sizes[b], self.sizes[a] - (a == b))
        (_, of_a, has_a, n_a), (_, of_b, has_b, n_b) = self.tiles[a], self.tiles[b]
        x, y = (np.unpackbits(has, axis=1).astype(np.float32) for has in (has_a, has_b))
        met = (x @ y.T > 0).astype(np.int64)
        own = np.diag(met) if a == b else 0
        return (met @ n_b - own)[of_a], (n_a @ met - own)[of_b]

    def bounds(self, a: int, b: int) -> tuple[np.ndarray, ...]:
        """Of each client of a, and of each of b: the least and the greatest that the sum of its distances to the other tile's clients can be, and how far one of these can be.

        Rounding changes a squared distance by no more than `off` times both squared norms, however its terms are added up.
        What is taken the root of is that much greater, so that sums of roots are never too small; they are too large by
        no more than what was added over the roots.
        """
        na, nb = self.tiles[a][0], self.tiles[b][0]
        off = 2.1 * (self.width + len(self.chunks) + 16) * SHORT
        least = max(off * float(na.mean() + nb.mean()), 1e-34)
        total = None
        for c in range(len(self.chunks) - 1):
            part = self.columns(a, c)[0] @ self.columns(b, c)[1].T
            total = part if total is None else np.add(total, part, out=total)
        x, y = self.columns(a, len(self.chunks) - 1)[0], self.columns(b, len(self.chunks) - 1)[1]
        x = np.concatenate([x, (off * na + least)[:, None], np.ones((len(na), 1))], 1, dtype=np.float32)
        y = np.ascontiguousarray(np.concatenate([y, np.ones((len(nb), 1)), (off * nb)[:, None]], 1, dtype=np.float32).T)
        sums = [np.zeros(len(na)), np.zeros(len(na)), np.zeros(len(nb)), np.zeros(len(nb))]
        strip = np.empty((min(STRIP, len(na)), len(nb)), np.float32)
        with np.errstate(invalid="ignore", divide="ignore"):
            for lo in range(0, len(na), STRIP):
                g = np.matmul(x[lo : lo + STRIP], y, out=strip[: min(STRIP, len(na) - lo)])
                if total is not None:
                    g += total[lo : lo + STRIP]
                for k in range(0, len(g), PIECE):
                    d, rows = g[k : k + PIECE], slice(lo + k, min(lo + k + PIECE, lo + len(g)))
                    np.sqrt(d, out=d)
                    sums[0][rows] = d.sum(1)
                    sums[2] += d.sum(0)
                    np.divide(np.float32(1), d, out=d)
                    sums[1][rows] = d.sum(1)
                    sums[3] += d.sum(0)
        out = []
        slack = (PIECE + 64) * SHORT
        for own, other, d, inverse in ((na, nb, *sums[:2]), (nb, na, *sums[2:])):
            top = float(other.max())
            added = 1.01 * (2 * off * (own + top) + least)
            low, high = (1 - slack) * d - (1 + slack) * added * inverse, (1 + slack) * d
            fine = np.isfinite(low) & np.isfinite(high)
            out += [np.where(fine, np.maximum(low, 0.0) * self.scale, -np.inf), np.where(fine, high * self.scale, np.inf), 1.001 * (np.sqrt(own) + top**0.5) * self.scale]
        return tuple(out)


def _lists(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each row's values begin (one more at the end), their places in the block, and the values."""
    column = lambda name: table.column(name).combine_chunks()
    length = lambda x: x.value_lengths().fill_null(0).to_numpy()
    i, f, d = column("i"), column("f"), column("d")
    is_float = length(f) > 0
    n = (length(f) + length(d)).astype(np.int64)
    at = np.append(0, np.cumsum(n))
    value = np.empty(at[-1])
    of_float = np.repeat(is_float, n)
    value[of_float] = f.flatten().to_numpy()
    value[~of_float] = d.flatten().to_numpy()
    idx = np.arange(at[-1]) + np.repeat(column("begin").to_numpy() - at[:-1], n)
    idx[np.repeat(length(i) > 0, n)] = i.flatten().to_numpy()
    return at, idx, value


def gathered(updates: DataFrame, width: int = WIDTH, order: str | None = None) -> DataFrame:
    """(grp, client, param, block, begin, i, f, d): a client's blocks, of rows that have one place the last in order, or the greatest."""
    keep = ["grp", "client", "param", "idx", "value"]
    rows = updates.select(*keep, *([order] if order and order not in keep else [])).where("value IS NOT NULL AND idx IS NOT NULL")
    block = ["grp", "client", "param", "block"]
    place, value = F.col("idx").cast("bigint") - F.col("block") * width, F.col("value").cast("double")
    rows = rows.withColumn("block", F.floor(F.col("idx") / width).cast("bigint")).withColumn("i", place.cast("int")).withColumn("v", value)
    if order:
        rows = rows.groupBy(*block).agg(F.sort_array(F.collect_list(F.struct("i", F.col(order).alias("o"), "v"))).alias("x"))
    else:
        rows = rows.groupBy(*block).agg(F.sort_array(F.arrays_zip(F.collect_list("i").alias("i"), F.collect_list("v").alias("v"))).alias("x"))
    rows = rows.withColumn("x", F.filter("x", lambda e, k: (k == F.size("x") - 1) | (F.get("x", k + 1)["i"] != e["i"])))
    # places only where some are left out, and floats where these are the values; empty arrays, as with null ones Spark's handing over of a batch to Python takes the square of its rows
    none = lambda kind: F.array().cast(f"array<{kind}>")
    size = F.size("x")
    rows = rows.withColumn("begin", F.col("x")[0]["i"]).withColumn("i", F.when(F.get("x", size - 1)["i"] - F.col("x")[0]["i"] != size - 1, F.col("x")["i"]).otherwise(none("int")))
    rows = rows.withColumn("short", F.forall("x", lambda e: e["v"].eqNullSafe(e["v"].cast("float").cast("double"))))
    rows = rows.withColumn("f", F.when(F.col("short"), F.col("x")["v"].cast("array<float>")).otherwise(none("float"))).withColumn("d", F.when(F.col("short"), none("double")).otherwise(F.col("x")["v"]))
    return rows.select(*block, "begin", "i", "f", "d")


def by_cells(blocks: DataFrame, make: Callable[[pa.Scalar, pa.DataType, Cell], Iterator[pa.RecordBatch]], schema: str, tile: int = TILE, width: int = WIDTH, chosen: DataFrame | None = None) -> DataFrame:
    """What `make` yields of each cell: of (grp, the type of clients, its blocks) batches of the schema.

    A group's tiles are dealt into PARTS parts, a cell has two of them: a block is shuffled PARTS times at most, however many clients there are.
    chosen: (grp, client) that alone are compared with all of their group; a cell has one part, and beside it the chosen clients' blocks.
    """
    spark = blocks.sparkSession
    ship_package(spark)
    tiles = blocks.groupBy("grp").agg(F.ceil(F.count_distinct("client") / tile).cast("int").alias("tiles"))
    own = F.pmod(F.xxhash64("client"), F.col("tiles")).cast("int")
    parts = F.least(F.col("tiles"), F.lit(PARTS))
    if chosen is None:
        rows = blocks.join(F.broadcast(tiles), "grp").withColumn("tile", own).withColumn("part", F.col("tile") % parts).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
        rows = rows.withColumn("s0", F.least("part", "other")).withColumn("s1", F.greatest("part", "other")).withColumn("first", F.col("part") == F.col("s0"))
    else:
        few = chosen.groupBy("grp").agg(F.ceil(F.count("*") / tile).cast("int").alias("few"))
        rows = blocks.join(F.broadcast(tiles.join(few, "grp")), "grp").withColumn("tile", own)
        rows = rows.join(chosen.select("grp", "client", F.lit(True).alias("asked")), ["grp", "client"], "left")
        # tiles of chosen clients count down from -1
        alone = -1 - F.pmod(F.xxhash64("client"), F.col("few")).cast("int")
        side = lambda part, tile, first: F.struct(part.alias("s0"), tile.alias("tile"), F.lit(first).alias("first"))
        all_of = F.array(side(F.col("tile") % parts, F.col("tile"), False))
        asked = F.transform(F.sequence(F.lit(0), parts - 1), lambda p: side(p, alone, True))
        rows = rows.withColumn("_to", F.explode(F.when(F.col("asked"), F.concat(all_of, asked)).otherwise(all_of))).drop("tile").select("*", "_to.*").withColumn("s1", F.lit(-1))
    rows = rows.select("grp", "s0", "s1", "first", "tile", "param", "block", "client", "begin", "i", "f", "d")
    # few bytes and much work: the number of tasks doesn't follow the size
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    keys = ("grp", "s0", "s1", "tile", "param", "block")
    rows = rows.repartition(tasks, "grp", "s0", "s1").sortWithinPartitions(*keys)

    def run(batches):
        now, cell = None, None
        for table, starts in whole_groups(batches, keys):
            grp, kind = table.schema.field("grp").type, table.schema.field("client").type
            at, idx, value = _lists(table)
            heads = table.select([*keys, "first"]).take(pa.array(starts))
            heads = list(zip(*(heads.column(k).to_pylist() for k in (*keys, "first")), strict=True))
            clients = table.column("client").to_pylist()
            for (*of, tile_of, param, number, first), lo, hi in zip(heads, starts.tolist(), [*starts[1:].tolist(), table.num_rows], strict=True):
                if cell is None or of != now:
                    if cell is not None:
                        yield from make(pa.scalar(now[0], grp), kind, cell)
                    now = of
                    cell = Cell(now[1] == now[2])
                places = idx[at[lo] : at[hi]]
                begin = int(places.min())
                x = np.full((hi - lo, int(places.max()) + 1 - begin), np.nan)
                x[np.repeat(np.arange(hi - lo), np.diff(at[lo : hi + 1])), places - begin] = value[at[lo] : at[hi]]
                there = ~np.isnan(x).all(0)
                cell.add(first, tile_of, (param, number), clients[lo:hi], np.flatnonzero(there) + begin, x if there.all() else x[:, there])
        if cell is not None:
            yield from make(pa.scalar(now[0], grp), kind, cell)

    return rows.mapInArrow(run, schema)


def kinds(updates: DataFrame) -> tuple[str, str]:
    found = dict(updates.dtypes)
    return found["grp"], found["client"]


def pair_sums(updates: DataFrame, tile: int = TILE, width: int = WIDTH, order: str | None = None) -> DataFrame:
    """(grp, a, b, total, shared) for a < b: squared distance and number of the coordinates that both clients have, where there is one."""
    grp, client = kinds(updates)

    def pairs(group: pa.Scalar, kind: pa.DataType, cell: Cell) -> Iterator[pa.RecordBatch]:
        for t0, t1, total, shared in cell.pairs():
            at, met = list(cell.places[0][t0]), list(cell.places[0 if cell.same else 1][t1])
            names = pa.array([*at, *met], kind)
            rank = np.empty(len(names), np.int64)
            rank[np.array(sorted(range(len(names)), key=[*at, *met].__getitem__), np.int64)] = np.arange(len(names))
            step = max(1, MOST // max(1, len(met)))
            for lo in range(0, len(at), step):
                i, j = np.nonzero(shared[lo : lo + step])
                if not len(i):
                    continue
                i += lo
                a, b = i, j + len(at)
                swap = rank[a] > rank[b]
                a, b = np.where(swap, b, a), np.where(swap, a, b)
                cols = [pa.repeat(group, len(i)), names.take(pa.array(a)), names.take(pa.array(b)), pa.array(total[i, j]), pa.array(shared[i, j].astype(np.int64))]
                yield pa.RecordBatch.from_arrays(cols, names=["grp", "a", "b", "total", "shared"])

    return by_cells(gathered(updates, width, order), pairs, f"grp {grp}, a {client}, b {client}, total double, shared bigint", tile, width)


def exact_sums(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of rows of numbers from 0 on, as a high part that is exact and a low one: together they hardly depend on the order."""
    most = float(x.max(initial=0.0))
    if not 0 < most < 1e300:
        return x.sum(1), np.zeros(len(x))
    unit = 2.0 ** (np.frexp(most)[1] + int(x.shape[1]).bit_length() + 1)
    high = (x + unit) - unit
    return high.sum(1), (x - high).sum(1)


class Far:
    """Of each client of a tile: how many it shares coordinates with, the `most` greatest distances, and the sum of the others in two parts."""

    def __init__(self, clients: int, most: int):
        self.most, self.m = most, np.zeros(clients, np.int64)
        self.high, self.low, self.far = np.zeros(clients), np.zeros(clients), np.zeros((clients, 0))

    def _sum(self, x: np.ndarray) -> None:
        s = self.high + x
        back = s - self.high
        lost = (self.high - (s - back)) + (x - back)
        self.high, self.low = s, self.low + np.where(np.isfinite(lost), lost, 0.0)

    def add(self, d: np.ndarray, has: np.ndarray) -> None:
        """Distances to the clients of another tile, and which there are."""
        d = np.where(has, d, -np.inf)
        far, rows = [], np.arange(len(d))
        for _ in range(min(self.most, d.shape[1]) if self.most <= 8 else 0):
            at = d.argmax(1)
            far.append(d[rows, at])
            d[rows, at] = -np.inf
        if self.most > 8:
            k = min(self.most, d.shape[1])
            at = np.argpartition(d, d.shape[1] - k, axis=1)[:, d.shape[1] - k :]
            far = list(np.take_along_axis(d, at, 1).T)
            np.put_along_axis(d, at, -np.inf, 1)
        d[d == -np.inf] = 0.0
        high, low = exact_sums(d)
        self.m += has.sum(1)
        self._sum(high)
        self.low += low
        if not far:
            return
        both = np.sort(np.concatenate([self.far, np.stack(far, 1)], axis=1), axis=1)
        self.far = both[:, max(0, both.shape[1] - self.most) :]
        for x in both[:, : max(0, both.shape[1] - self.most)].T:
            self._sum(np.where(x == -np.inf, 0.0, x))

    def batch(self, names: pa.Array, group: pa.Scalar) -> pa.RecordBatch:
        there = self.far != -np.inf
        far = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(there.sum(1))).astype(np.int32)), pa.array(self.far[there]))
        out = pa.RecordBatch.from_arrays([pa.repeat(group, len(names)), names, pa.array(self.m), pa.array(self.high), pa.array(self.low), far], names=["grp", "client", "m", "high", "low", "far"])
        return out.filter(pa.array(self.m > 0))


def far_sums(updates: DataFrame, most: int, tile: int = TILE, order: str | None = None) -> DataFrame:
    """As far_sums_of, of updates."""
    return far_sums_of(gathered(updates, order=order), most, tile)


def far_sums_of(blocks: DataFrame, most: int, tile: int = TILE, chosen: DataFrame | None = None) -> DataFrame:
    """(grp, client, m, high, low, far) of a client (or of those in chosen) and the clients of one cell: how many it shares coordinates with, the `most` greatest distances, and the sum of the others in two parts."""
    grp, client = kinds(blocks)
    some = chosen is not None

    def sums(group: pa.Scalar, kind: pa.DataType, cell: Cell) -> Iterator[pa.RecordBatch]:
        sides = cell.places[:1] if some else cell.places
        found = {t: Far(len(places), most) for side in sides for t, places in side.items()}
        for t0, t1, total, shared in cell.pairs():
            has = shared > 0
            d = np.sqrt(total)
            if t0 == t1:
                d = np.triu(d, 1)
                d += d.T
                found[t0].add(d, has | has.T)
            elif not some:
                found[t0].add(d, has)
                found[t1].add(np.ascontiguousarray(d.T), np.ascontiguousarray(has.T))
            else:
                # a chosen client is among all of its group as well
                there = cell.places[1][t1]
                self_at = [(i, there[c]) for c, i in cell.places[0][t0].items() if c in there]
                if self_at:
                    has[tuple(np.array(self_at).T)] = False
                found[t0].add(d, has)
        for side in sides:
            for t, places in side.items():
                yield found[t].batch(pa.array(list(places), kind), group)

    return by_cells(blocks, sums, f"grp {grp}, client {client}, m bigint, high double, low double, far array<double>", tile, chosen=chosen)


def bound_sums(blocks: DataFrame, tile: int = TILE) -> DataFrame:
    """(grp, client, m, low, high, top) of a client and the clients of one cell: how many it shares coordinates with, bounds of the sum of its distances, and how far one of them can be. Without finite bounds also m is open."""
    grp, client = kinds(blocks)

    def sums(group: pa.Scalar, kind: pa.DataType, cell: Cell) -> Iterator[pa.RecordBatch]:
        layout = Layout(cell)
        known = {t: places for side in cell.places for t, places in side.items()}
        found = {t: [np.zeros(len(places), np.int64), *(np.zeros(len(places)) for _ in range(3))] for t, places in known.items()}
        if not layout.bounded:
            for m, low, high, top in found.values():
                m += 1
                low -= np.inf
                high += np.inf
                top += np.inf
        else:
            for t0 in cell.places[0]:
                for t1 in cell.places[0 if cell.same else 1]:
                    if cell.same and t1 < t0:
                        continue
                    # a client's distance to itself is 0, and it is within these bounds
                    bounds, meets = layout.bounds(t0, t1), layout.meets(t0, t1)
                    for t, of, m in ((t0, bounds[:3], meets[0]), (t1, bounds[3:], meets[1]))[: 1 if t0 == t1 else 2]:
                        x = found[t]
                        x[0] += m
                        x[1] += of[0]
                        x[2] += of[1]
                        np.maximum(x[3], of[2], out=x[3])
        for t, places in known.items():
            cols = [pa.repeat(group, len(places)), pa.array(list(places), kind), *map(pa.array, found[t])]
            yield pa.RecordBatch.from_arrays(cols, names=["grp", "client", "m", "low", "high", "top"])

    return by_cells(blocks, sums, f"grp {grp}, client {client}, m bigint, low double, high double, top double", tile)
