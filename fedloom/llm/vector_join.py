"""Near-duplicate vectors by product quantisation.

1. Vectors that are equal within a label are one row from the start, with their number.
2. Coarse centres and, for each of SUBSPACES parts of a residual, CODES code words are fitted on a bounded sample
   (SAMPLE vectors, SAMPLE_VALUES numbers at most). Every vector is indexed: it enters the inverted list of its
   nearest centre with its residual's codes and the length of what the codes leave out.
3. A vector also meets each list behind its own whose border, the plane halfway between both centres, is not
   farther than `margin`. A vector within the distance r of it (r = sqrt(2 - 2 least) on the unit sphere) can't
   be behind a border farther than r; margin = r therefore finds every pair. The default is half of it, since
   a difference of length r points straight at a border only by chance.
4. In a list, table look-ups give distances between a vector and the coded ones. By the triangle inequality a
   pair is left out only if that distance, less the coding error, is above r: no pair is lost here.
5. Pairs that are left get their exact cosine in double precision.

Lists are cut into tiles, whose pairs are tasks' groups; a group gives sums of links for each vector and the
links of a spanning forest, never all its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import Scratch
from .components import components
from .textscan import released

LEAST = 0.98
SAMPLE, SAMPLE_VALUES = 32_768, 1 << 22
LISTS = 4096  # at most; the square root of the number of vectors otherwise
SUBSPACES, CODES = 16, 256
LONGEST = 1024  # leading components that are indexed; distances over them are no longer than whole ones
TILE = 2048
BLOCK = 256
SALTS = 32


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = 0.5 * (centres * centres).sum(1)
    return np.concatenate([np.argmax(x[i : i + 4096] @ centres.T - half, axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def k_means(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k centres of x, from rows that are evenly spaced over it; a centre that loses all its rows stays."""
    k = max(1, min(k, len(x)))
    centres = x[np.linspace(0, len(x) - 1, k).astype(np.int64)].copy()
    for _ in range(rounds):
        at = _nearest(x, centres)
        order = np.argsort(at, kind="stable")
        found, begin = np.unique(at[order], return_index=True)
        sums = np.add.reduceat(x[order], begin, axis=0)
        centres[found] = sums / np.diff(np.append(begin, len(x)))[:, None]
    return centres


def unit(flat: np.ndarray, offsets: np.ndarray, width: int) -> np.ndarray:
    """The first width components of vectors scaled to length 1, shorter ones with zeros behind."""
    n = np.diff(offsets)
    row = np.repeat(np.arange(len(n)), n)
    top = np.maximum.reduceat(np.abs(flat), offsets[:-1]) if len(n) else np.zeros(0)
    x = flat / top[row]
    x /= np.sqrt(np.bincount(row, x * x, len(n)))[row]
    col = np.arange(len(flat)) - np.repeat(offsets[:-1], n)
    out = np.zeros((len(n), width), np.float32)
    keep = col < width
    out[row[keep], col[keep]] = x[keep]
    return out


class Quantiser:
    """Coarse centres and residual code books of unit vectors."""

    def __init__(self, sample: np.ndarray, lists: int):
        width = sample.shape[1]
        self.width = width
        self.centres = k_means(sample, lists)
        residual = sample - self.centres[_nearest(sample, self.centres)]
        self.cuts = np.unique(np.linspace(0, width, min(SUBSPACES, width) + 1).astype(int)).tolist()
        self.books = [k_means(residual[:, a:b], CODES, 6) for a, b in zip(self.cuts, self.cuts[1:], strict=False)]
        gap = ((self.centres[:, None, :] - self.centres[None]) ** 2).sum(2) if len(self.centres) <= 512 else np.stack([((self.centres - c) ** 2).sum(1) for c in self.centres])
        self.gap = np.sqrt(np.maximum(gap, 1e-12)).astype(np.float32)

    def lists(self, x: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each vector's own list, and (row, list) of the lists behind it that it has to meet."""
        parts = []
        for lo in range(0, len(x), TILE):
            y = x[lo : lo + TILE]
            d = (y * y).sum(1)[:, None] + (self.centres * self.centres).sum(1) - 2 * (y @ self.centres.T)
            own = d.argmin(1)
            border = (d - d[np.arange(len(y)), own][:, None]) / (2 * self.gap[own])
            row, other = np.nonzero(border <= margin + 1e-4)
            keep = other > own[row]
            parts.append((own, lo + row[keep], other[keep]))
        return tuple(np.concatenate(z) for z in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 3

    def encode(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and how long what they leave out is."""
        codes = np.empty((len(residual), len(self.books)), np.uint8)
        left = np.zeros(len(residual))
        for m, book in enumerate(self.books):
            part = residual[:, self.cuts[m] : self.cuts[m + 1]]
            codes[:, m] = at = _nearest(part, book)
            left += ((part - book[at]) ** 2).sum(1)
        return codes, np.sqrt(left).astype(np.float32)

    def tables(self, residual: np.ndarray) -> list[np.ndarray]:
        """For each subspace, squared distances of each row's part to the code words."""
        out = []
        for m, book in enumerate(self.books):
            part = residual[:, self.cuts[m] : self.cuts[m + 1]]
            out.append((part * part).sum(1)[:, None] + (book * book).sum(1) - 2 * (part @ book.T))
        return out


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """A list column's numbers and offsets, from 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), offsets - offsets[0]


def forest(adjacent: np.ndarray, square: bool) -> list[tuple[int, int]]:
    """(root, node) for the nodes of each component; rows are nodes from 0 on, columns follow them unless the matrix is square."""
    rows, cols = adjacent.shape
    seen_row, seen_col = ~adjacent.any(1), ~adjacent.any(0)
    out = []
    for start in np.flatnonzero(~seen_row).tolist():
        if seen_row[start]:
            continue
        front = np.array([start])
        seen_row[start] = True
        while len(front):
            found = np.flatnonzero(adjacent[front].any(0) & ~seen_col)
            seen_col[found] = True
            if square:
                front = found[~seen_row[found]]
                seen_row[front] = True
                out += [(start, x) for x in front.tolist()]
            else:
                out += [(start, rows + x) for x in found.tolist()]
                front = np.flatnonzero(adjacent[:, found].any(1) & ~seen_row) if len(found) else found
                seen_row[front] = True
                out += [(start, x) for x in front.tolist()]
    return out


def group_links(quantiser: Quantiser, at: int, coded, met, same: bool, least: float):
    """Adjacency of a group. coded: (unit vectors, whole vectors, codes, errors) of the list's tile; met: (unit, whole) of what it meets, itself if same."""
    x, whole, codes, error = coded
    y, other = met
    reach = np.float32(np.sqrt(max(0.0, 2 - 2 * least)) + 1e-3)
    centre = quantiser.centres[at]
    norm, other_norm = np.sqrt((whole * whole).sum(1)), np.sqrt((other * other).sum(1))
    adjacent = np.zeros((len(x), len(y)), bool)
    for lo in range(0, len(y), BLOCK):
        tables = quantiser.tables(y[lo : lo + BLOCK] - centre)
        far = np.zeros((min(BLOCK, len(y) - lo), len(x)), np.float32)
        for m, t in enumerate(tables):
            far += t[:, codes[:, m]]
        near = np.sqrt(np.maximum(far, 0)) - error <= reach
        if same:
            near &= np.arange(len(x)) < np.arange(lo, lo + len(near))[:, None]
        i, j = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
        if len(i):
            cosine = (other[lo + i] @ whole[j].T) / (other_norm[lo + i][:, None] * norm[j])
            adjacent[np.ix_(j, lo + i)] = ((cosine >= least) & near[np.ix_(i, j)]).T
    return adjacent | adjacent.T if same else adjacent


def _valid(v: Column) -> Column:
    """Not null, not empty, all components finite, one of them not 0."""
    kind = lambda x: x.cast("double")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(kind(x)) & (F.abs(kind(x)) < float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def fit(vectors: DataFrame, count: int) -> Quantiser:
    """On those of least hash, as many as SAMPLE and SAMPLE_VALUES allow; of vectors (hash, v)."""
    width = min(LONGEST, vectors.agg(F.max(F.size("v"))).first()[0])
    rows = max(1, min(SAMPLE, SAMPLE_VALUES // width))
    found = vectors.orderBy("hash").limit(rows).select("v").toArrow().column(0)
    sample = unit(*_flat(found), width)
    return Quantiser(sample, max(1, min(LISTS, int(count**0.5))))


def similar_vectors(
    spark: SparkSession, df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = LEAST, margin: float | None = None
) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row.

    Rows with equal labels, not null, are linked where the cosine of their vectors is at least `least`. A vector
    that is null, empty, zero, or has null or non-finite components is linked with nothing, nor are vectors of
    different lengths. Every row is a vector of its own: equal ones, repeated rows too, are linked. Null ids count
    as no id when a component's least one is taken; a component of such rows alone has null and is kept. An empty
    table gives an empty result; columns besides the three aren't read.
    """
    margin = (2 - 2 * least) ** 0.5 / 2 if margin is None else margin
    scratch = Scratch(spark)
    c = lambda n: F.col(f"`{n}`")
    rows = df.select(c(id_col).alias("vec_id"), c(label).alias("label"), c(vector).alias("v"))
    ok = _valid(F.col("v")) & F.col("label").isNotNull()
    # 128 bits stand for a vector; a very common one is dealt by ids first
    rows = rows.select(
        "vec_id", F.when(ok, F.col("label")).alias("label"), F.when(ok, F.col("v")).alias("v"),
        F.xxhash64("v").alias("hash"), F.xxhash64("v", F.lit(1)).alias("hash2"), F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int").alias("salt"),
    )
    key = ["label", "hash", "hash2"]
    dealt = rows.where("label IS NOT NULL").groupBy(*key, "salt").agg(F.first("v").alias("v"), F.count("*").alias("m"), F.min("vec_id").alias("least"))
    dealt = scratch.table(dealt, "vectors-dealt")
    nodes = dealt.groupBy(*key).agg(F.first("v").alias("v"), F.sum("m").alias("m"), F.min("least").alias("least"))
    nodes = scratch.table(nodes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    count = nodes.count()
    if count == 0:
        scratch.drop_but()
        return rows.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = _links(spark, scratch, nodes, fit(nodes, count), least, margin)
    comps = components(scratch, found.where("b IS NOT NULL").select("a", "b"))
    sums = found.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    placed = nodes.select(*key, "node", "m", "least").join(sums, "node", "left").join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = scratch.table(placed, "vectors-placed")
    ids = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    told = placed.join(ids, "component").select(*key, (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), "component_id")
    told = scratch.table(dealt.select(*key, "salt").join(told, key), "vectors-told")
    scratch.drop_but(told)
    out = rows.drop("v").join(told, [*key, "salt"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _links(spark: SparkSession, scratch: Scratch, nodes: DataFrame, quantiser: Quantiser, least: float, margin: float) -> DataFrame:
    """(a, b, null) for the links of a spanning forest of each group, (a, null, n) for how many rows a vector is linked with there."""
    shared = spark.sparkContext.broadcast(quantiser)
    kind = nodes.schema["v"].dataType.simpleString()
    label = nodes.schema["label"].dataType.simpleString()

    def deal(batches):
        q = shared.value
        for batch in batches:
            flat, offsets = _flat(batch.column(3))
            x = unit(flat, offsets, q.width)
            own, row, other = q.lists(x, margin)
            codes, error = q.encode(x - q.centres[own])
            n = len(x)
            take = pa.array(np.concatenate((np.arange(n), row)))
            raw = [r.tobytes() for r in codes]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), pa.array(np.concatenate((np.diff(offsets), np.diff(offsets)[row])), pa.int32()), pa.array(np.concatenate((own, other)), pa.int32()),
                 batch.column(1).take(take), batch.column(2).take(take), batch.column(3).take(take), pa.array(raw + [None] * len(row), pa.binary()), pa.array(np.concatenate((error, np.zeros(len(row)))), pa.float32())],
                names=["label", "dims", "list", "node", "m", "v", "code", "error"],
            )

    place = ["label", "dims", "list"]
    lists = nodes.select("label", "node", "m", "v").mapInArrow(released(deal), f"label {label}, dims int, list int, node bigint, m bigint, v {kind}, code binary, error float")
    lists = scratch.table(lists, "vectors-lists")
    tiles = lists.groupBy(*place).agg(F.ceil(F.count("code") / TILE).cast("int").alias("tiles"), F.ceil(F.count_if(F.col("code").isNull()) / TILE).cast("int").alias("others"))
    rows = lists.join(tiles.where("tiles > 0"), place)
    inside = F.col("code").isNotNull()
    tile = F.pmod(F.xxhash64("node"), F.when(inside, F.col("tiles")).otherwise(F.col("others"))).cast("int")
    rows = rows.withColumn("tile", F.when(inside, tile).otherwise(F.col("tiles") + tile))
    # a tile of the list meets itself, its later ones and those of other lists' vectors
    ends = F.col("tiles") + F.col("others") - 1
    first = F.transform(F.sequence(F.col("tile"), ends), lambda t: F.struct(F.col("tile").alias("t0"), t.alias("t1")))
    last = F.transform(F.sequence(F.lit(0), F.least("tile", "tiles") - 1), lambda t: F.struct(t.alias("t0"), F.col("tile").alias("t1")))
    none = F.slice(first, 1, 0)
    groups = F.when(inside, F.concat(first, F.when(F.col("tile") > 0, last).otherwise(none))).otherwise(last)
    rows = rows.withColumn("g", F.explode(groups)).select(*place, "g.t0", "g.t1", "tile", "node", "m", "v", "code", "error")

    def link(table: pa.Table) -> pa.Table:
        q = shared.value
        at, t0, t1 = (table.column(k)[0].as_py() for k in ("list", "t0", "t1"))
        flat, offsets = _flat(table.column("v"))
        width = int(offsets[1])
        # scaled by a power of two, which keeps all digits
        whole = flat.reshape(-1, width)
        whole = np.ldexp(whole, -np.frexp(np.abs(whole).max(1))[1][:, None])
        x = unit(flat, offsets, q.width)
        mine = table.column("tile").to_numpy() == t0
        node, m = table.column("node").to_numpy(), table.column("m").to_numpy()
        codes = np.frombuffer(b"".join(z for z, k in zip(table.column("code").to_pylist(), mine.tolist(), strict=True) if k), np.uint8).reshape(-1, len(q.books))
        coded = (x[mine], whole[mine], codes, table.column("error").to_numpy()[mine])
        same = t0 == t1
        met = ~mine
        names = {"a": pa.int64(), "b": pa.int64(), "n": pa.int64()}
        if not mine.any() or not (same or met.any()):
            return pa.table({k: pa.array([], t) for k, t in names.items()})
        adjacent = group_links(q, at, coded, (coded[0], coded[1]) if same else (x[met], whole[met]), same, least)
        ids = node[mine] if same else np.concatenate((node[mine], node[met]))
        sums = adjacent @ m[mine if same else met].astype(np.float64)
        if not same:
            sums = np.concatenate((sums, m[mine].astype(np.float64) @ adjacent))
        linked = np.flatnonzero(sums > 0)
        tree = np.array(forest(adjacent, same), np.int64).reshape(-1, 2)
        a, b = np.concatenate((ids[tree[:, 0]], ids[linked])), ids[tree[:, 1]]
        return pa.table({
            "a": pa.array(a, pa.int64()), "b": pa.concat_arrays([pa.array(b, pa.int64()), pa.nulls(len(linked), pa.int64())]),
            "n": pa.concat_arrays([pa.nulls(len(b), pa.int64()), pa.array(sums[linked].astype(np.int64), pa.int64())]),
        })

    links = rows.groupBy(*place, "t0", "t1").applyInArrow(link, "a bigint, b bigint, n bigint")
    links = scratch.table(links, "vectors-links")
    scratch.drop(lists)
    return links


VECTOR_SQL = """
WITH RECURSIVE ok AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), least AS (
  SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
), n AS (
  SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a
)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings LEFT JOIN n USING (vec_id) JOIN least USING (vec_id)
"""
