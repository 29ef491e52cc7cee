"""Similarity join of documents on n-gram sets (Jaccard), as a blocked sparse matrix product.

The incidence matrix has a row for each distinct n-gram set and a column for each n-gram. Two sets with a
Jaccard of t share a column within the first n - ceil(t n) + 1 columns of each, whatever order the columns
have; only these entries enter the product. It is computed in blocks of columns, each by one task on arrays.

1. A count sketch of fixed size finds frequent columns; they come last in the order, so that passages which
   many documents share don't enter the product unless a document is made of them. The order changes the work
   and never the result; SKETCH_BITS should give cells for a sixteenth of all n-grams.
2. Blocks give the columns that two sets or more share: all pairs of columns of SMALL sets at most, the members
   of the others.
3. Pairs are discarded by bounds derived from sizes alone: t max(n) <= min(n), and, from bit maps of about two
   bits for each n-gram, the least possible size of the symmetric difference. What is left is compared whole.
4. A large group of near copies would give all its pairs. So each set is first compared with a fixed number of
   hubs, over all its columns, then with a fixed number of the nearest sets by bit map, with the components of
   the links between; then only pairs of sets that aren't in one component yet are compared, all of them. Equal
   sets are one row from the start.

Every pair that is linked is thus either compared or within one component already.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.selection import with_state
from ..plans.session import Scratch, arrow_batches
from .components import components
from .textscan import Words, mix, ngrams, released, signed, slices, text_array

N = 5
PERCENT = 75
SKETCH_BITS = 24
SLICE_BITS = 18
FREQUENT = 32
SMALL = 4
DEALT = 1 << 20  # entries that a task has in memory before it deals them out
TILE = 512
FOUND = 1 << 16
BATCH = 2_000  # rows that are handed to Python at once: texts, or pairs of whole sets
BLOOM_BITS = 26
HUBS = 3  # hubs that a set is compared with
NEAREST = 4  # sets nearest by bit map that it is compared with then
SHOWN = 16


def shingle_sets(words: Words, n: int = N):
    """(row, sorted distinct 64-bit hashes) of each row's n-word shingles; the whole sequence as one if it is shorter, none without words."""
    h = words.hashes()
    g = ngrams(h, n)
    first = words.first.tolist()
    for r in range(words.rows):
        a, b = first[r], first[r + 1]
        if b - a >= n:
            yield r, np.unique(g[a : b - n + 1])
        elif b > a:
            yield r, ngrams(h[a:b], b - a) ^ np.uint64(b - a)
        else:
            yield r, np.zeros(0, np.uint64)


def _signature(s: np.ndarray) -> int:
    """Of a whole set, 64 bits."""
    total = mix(s + np.uint64(len(s))).sum(dtype=np.uint64)
    return int(signed(mix(np.array([total + np.uint64(len(s))], np.uint64)))[0])


def _needed(n: int, percent: int) -> int:
    """Columns of a set of n that enter the product."""
    return n - -(-percent * n // 100) + 1


def _bits(s: np.ndarray) -> bytes:
    """Parities of the set's hashes in a power of two of cells, two for each n-gram at least."""
    cells = max(64, 1 << (2 * len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """No larger than the size of the symmetric difference of the two sets: their odd cells differ in so many places."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _sets_of(batches, text_at: int):
    for batch in batches:
        texts = text_array(batch.column(text_at))
        for i, j in slices(texts):
            yield batch, i, Words(texts, i, j, lower=True)


def _summed_slices(rows: DataFrame, parts: int, what: str) -> list[tuple[int, np.ndarray]]:
    """Of arrays that tasks emit as rows (slice, raw), slice by slice the sums of their bytes (ending at 65,535; what = "counts") or their union (what = "bits"). The result has a fixed size."""
    dtype = np.uint16 if what == "counts" else np.uint8

    def run(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(zlib.decompress(raw), np.uint8)
                if what == "bits":
                    held[k] = held[k] | x if k in held else x
                else:
                    held[k] = np.minimum(held[k].astype(np.uint32) + x, 65535).astype(np.uint16) if k in held else x.astype(np.uint16)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([zlib.compress(v.tobytes(), 1) for v in held.values()], pa.binary())], names=["slice", "raw"])

    found = rows.repartition(parts, "slice").mapInArrow(released(run), "slice int, raw binary").collect()
    return [(k, np.frombuffer(zlib.decompress(raw), dtype)) for k, raw in found]


def frequent_columns(docs: DataFrame) -> np.ndarray:
    """Packed bits of the sketch's cells that count as frequent. All documents are counted; what comes to the driver has a fixed size, compressed."""
    size = 1 << SLICE_BITS

    def run(batches):
        cells = np.zeros(1 << SKETCH_BITS, np.uint8)  # a task's counts end at 255
        for _, _, words in _sets_of(batches, 0):
            sets = [s for _, s in shingle_sets(words) if len(s)]
            if sets:
                cell, n = np.unique((np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), return_counts=True)
                cells[cell] = np.minimum(cells[cell] + n, 255)
        for k in range(0, 1 << (SKETCH_BITS - SLICE_BITS)):
            part = cells[k * size : (k + 1) * size]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], names=["slice", "raw"])

    hot = np.zeros(1 << (SKETCH_BITS - 3), np.uint8)
    found = _summed_slices(docs.select("text").mapInArrow(released(run), "slice int, raw binary"), 16, "counts")
    mean = sum(float(x.sum()) for _, x in found) / (1 << SKETCH_BITS)
    for k, x in found:
        hot[k * size // 8 : (k + 1) * size // 8] = np.packbits(x >= max(FREQUENT, 4 * mean), bitorder="little")
    return hot


def _set_table(scratch: Scratch, docs: DataFrame) -> DataFrame:
    """doc_id, n, s (the set's signature) and, once for each set and batch, bits."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        seen: set[int] = set()
        last = None
        for batch, i, words in _sets_of(batches, 1):
            if batch is not last:
                seen, last = set(), batch
            ns, ss, bits = [], [], []
            for _, s in shingle_sets(words):
                sign = _signature(s) if len(s) else None
                ns.append(len(s))
                ss.append(sign)
                bits.append(None if sign is None or sign in seen else _bits(s))
                seen.add(sign)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, words.rows), pa.array(ns, pa.int64()), pa.array(ss, pa.int64()), pa.array(bits, pa.binary())], names=["doc_id", "n", "s", "bits"])

    return scratch.table(docs.select("doc_id", "text").mapInArrow(released(run), f"doc_id {id_type}, n bigint, s bigint, bits binary"), "ngram-sets")


def first_columns(s: np.ndarray, hot: np.ndarray, percent: int) -> np.ndarray:
    """A set's columns that enter the product: by hash, frequent ones last."""
    p = _needed(len(s), percent)
    cell = (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
    late = (hot[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1
    rare = s[late == 0]
    return rare[:p] if len(rare) >= p else np.concatenate((rare, s[late == 1]))[:p]


def _small_pairs(s: np.ndarray, n: np.ndarray, place: np.ndarray, total: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs (a < b) of sets of columns of SMALL sets at most, if their sizes allow a link. Rows stand column by column."""
    a, b = [], []
    for d in range(1, SMALL):
        i = np.flatnonzero((total <= SMALL) & (place + d < total))
        x, y = n[i], n[i + d]
        i = i[np.minimum(x, y).astype(np.int64) * 100 >= np.maximum(x, y).astype(np.int64) * percent]
        a.append(np.minimum(s[i], s[i + d]))
        b.append(np.maximum(s[i], s[i + d]))
    a, b = np.concatenate(a), np.concatenate(b)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def _shared_columns(spark: SparkSession, scratch: Scratch, docs: DataFrame, percent: int) -> DataFrame:
    """Of the columns that two sets or more have among their first ones: (h, s, n) for each set of a column of more than SMALL sets, (null, s, t) for the pairs of others.

    Entries travel as arrays: 40 bits of the column beside its block, and a row number into a list of sets.
    A clash of columns adds pairs to be compared, never removes one. Equal sets of a batch travel once.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = 4 * parts
    hot_bits = spark.sparkContext.broadcast(frequent_columns(docs))

    def dealt(sets: dict[int, tuple[int, np.ndarray]]) -> pa.RecordBatch:
        s = np.array(list(sets), np.int64)
        n = np.array([x[0] for x in sets.values()], np.int32)
        rows = [x[1] for x in sets.values()]
        h = np.concatenate(rows)
        row = np.repeat(np.arange(len(rows)), [len(x) for x in rows]).astype(np.uint16)
        block = ((h >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        h, row, block = h[order], row[order], block[order]
        a, out = 0, []
        for b in (np.flatnonzero(np.diff(block, append=-1)) + 1).tolist():
            used, place = np.unique(row[a:b], return_inverse=True)
            low = h[a:b].view(np.uint8).reshape(-1, 8)[:, :5]
            out.append((int(block[a]), low.tobytes(), place.astype(np.uint16).tobytes(), s[used].tobytes(), n[used].tobytes()))
            a = b
        cols = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]]], names=["block", "low", "place", "sets", "sizes"])

    def deal(batches):
        hot = hot_bits.value
        held: dict[int, tuple[int, np.ndarray]] = {}
        entries = 0
        for _, _, words in _sets_of(batches, 0):
            for _, s in shingle_sets(words):
                if len(s) and (sign := _signature(s)) not in held:
                    held[sign] = (len(s), first_columns(s, hot, percent))
                    entries += len(held[sign][1])
                    if entries >= DEALT or len(held) == 1 << 16:  # rows are told by 16 bits
                        yield dealt(held)
                        held, entries = {}, 0
        if held:
            yield dealt(held)

    def product(batches):
        # rows come block by block, and one block is held at a time
        at, found = -1, []
        for batch in batches:
            for block, low, place, sets_, sizes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block != at and found:
                    yield from multiplied(at, found)
                    found = []
                at = block
                x = np.zeros((len(low) // 5, 8), np.uint8)
                x[:, :5] = np.frombuffer(low, np.uint8).reshape(-1, 5)
                held = np.frombuffer(place, np.uint16)
                found.append((x.view(np.uint64).ravel(), np.frombuffer(sets_, np.int64)[held], np.frombuffer(sizes, np.int32)[held]))
        if found:
            yield from multiplied(at, found)

    def multiplied(block, found):
        h, s, n = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((s, h))
        h, s, n = h[order], s[order], n[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (s[1:] != s[:-1])
        h, s, n = h[new], s[new], n[new]
        begin = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        count = np.diff(np.append(begin, len(h)))
        keep = np.flatnonzero(np.repeat(count > 1, count))
        h, s, n, total = h[keep], s[keep], n[keep], np.repeat(count, count)[keep]
        place = (np.arange(int(count.sum())) - np.repeat(begin, count))[keep]
        a, b = _small_pairs(s, n, place, total, percent)
        for lo in range(0, len(a), FOUND):
            part = slice(lo, lo + FOUND)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(a[part]), pa.int64()), pa.array(a[part]), pa.array(b[part]), pa.nulls(len(a[part]), pa.int64())], names=["h", "s", "t", "n"])
        large = total > SMALL
        key, s, n = signed(h[large] | np.uint64(block) << np.uint64(40)), s[large], n[large].astype(np.int64)
        for lo in range(0, len(s), FOUND):
            part = slice(lo, lo + FOUND)
            yield pa.RecordBatch.from_arrays([pa.array(key[part]), pa.array(s[part]), pa.nulls(len(s[part]), pa.int64()), pa.array(n[part])], names=["h", "s", "t", "n"])

    entries = docs.select("text").mapInArrow(released(deal), "block int, low binary, place binary, sets binary, sizes binary")
    return scratch.table(entries.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(released(product), "h bigint, s bigint, t bigint, n bigint"), "ngram-columns")


def _few_each(pairs: DataFrame, most: int) -> DataFrame:
    """(a, b) of (s, t, rank): for each s the most ones of least rank."""
    least = pairs.groupBy("s").agg(F.slice(F.array_sort(F.collect_set(F.struct("rank", "t"))), 1, most).alias("found"))
    return least.select("s", F.explode("found.t").alias("t")).select(F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b"))


def _hub_pairs(lists: DataFrame, hubs: int, percent: int) -> DataFrame:
    """(a, b): each set beside at most so many hubs. A column's hub is its least set by hash; a set takes the least ones over all its columns, which sets of one group mostly have in common."""
    rank = F.xxhash64("s")
    hub = lists.groupBy("h").agg(F.min_by(F.struct(F.col("s").alias("t"), F.col("n").alias("m"), rank.alias("rank")), rank).alias("hub"))
    # a column of many sets is dealt by set, its one hub goes to each part
    met = with_state(lists, hub, ["h"], F.col("s")).select("s", "n", "hub.*").where((F.least("n", "m") * 100 >= F.greatest("n", "m") * percent) & (F.col("s") != F.col("t")))
    return _few_each(met, hubs)


def _remaining_pairs(spark: SparkSession, lists: DataFrame, sets: DataFrame, percent: int, nearest: int = 0) -> DataFrame:
    """(a, b) of sets of one column and different components that may be similar by their sizes and bits; nearest: only so many for each set, those of least difference by bits.

    Sets of a column's largest component need no comparison with each other. They are cut into tiles of about
    TILE by hash, and so are the others; each tile of the others meets all tiles. A task has two tiles of a
    column in memory. Each set carries the first SHOWN of its columns, so that a pair is left to the first
    column that both show.
    """
    main = lists.groupBy("h", "c").agg(F.count("*").alias("k")).groupBy("h").agg(F.max_by("c", F.struct("k", "c")).alias("main"), F.max("k").alias("most"), F.sum("k").alias("total"))
    open_ = with_state(lists, main.where("most < total"), ["h"], F.col("s"))
    shown = open_.groupBy("s").agg(F.slice(F.array_sort(F.collect_list("h")), 1, SHOWN).alias("shown"))
    others = F.ceil((F.col("total") - F.col("most")) / TILE).cast("int")
    mains = F.ceil(F.col("most") / TILE).cast("int")
    rows = open_.withColumn("in_main", F.col("c") == F.col("main")).withColumn("others", others).withColumn("mains", mains)
    # tiles of the largest component have negative numbers
    rows = rows.withColumn("tile", F.when(F.col("in_main"), -1 - F.pmod(F.xxhash64("s"), F.col("mains"))).otherwise(F.pmod(F.xxhash64("s"), F.col("others"))).cast("int"))
    met = F.when(F.col("in_main"), F.sequence(F.lit(0), F.col("others") - 1)).otherwise(F.sequence(-F.col("mains"), F.col("others") - 1))
    rows = rows.select("h", "s", "n", "c", "tile", F.explode(met).alias("other"))
    rows = rows.select("h", F.least("tile", "other").alias("t0"), F.greatest("tile", "other").alias("t1"), "s", "n", "c", "tile")
    rows = rows.join(sets.select("s", "bits").join(shown, "s"), "s").select("h", "t0", "t1", "s", "n", "c", "tile", "bits", "shown")
    dealt = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "h", "t0", "t1").sortWithinPartitions("h", "t0", "t1")

    def tile_pairs(h, s, n, c, tile, bits, shown, within: bool):
        """Pairs of one group, as arrays: a row of it against those behind it."""
        order = np.argsort(n, kind="stable")
        s, n, c, tile = s[order], n[order], c[order], tile[order]
        bits = [bits[i] for i in order.tolist()]
        shown = [{x for x in shown[i] if x < h} for i in order.tolist()]
        width = min(map(len, bits))
        folded = np.empty((len(bits), width // 8), np.uint64)
        for i, x in enumerate(bits):
            y = np.frombuffer(x, np.uint64)
            while len(y) > width // 8:
                y = y[: len(y) // 2] ^ y[len(y) // 2 :]
            folded[i] = y
        for i in range(len(s) - 1):
            stop = int(np.searchsorted(n, n[i] * 100 // percent, side="right"))
            j = np.arange(i + 1, stop)
            j = j[(c[j] != c[i]) & ((tile[j] != tile[i]) if not within else True)]
            if len(j):
                least = np.bitwise_count(folded[j] ^ folded[i]).sum(axis=1)
                j = j[(100 + percent) * least <= (100 - percent) * (n[i] + n[j])]
                found = []
                for k in j.tolist():
                    if shown[i].isdisjoint(shown[k]):
                        d = least_difference(bits[i], bits[k])
                        if (100 + percent) * d <= (100 - percent) * int(n[i] + n[k]):
                            found.append((d, k))
                if nearest and len(found) > nearest:
                    found = sorted(found)[:nearest]
                if found:
                    d, k = np.array(found, np.int64).T
                    yield np.full(len(k), s[i]), s[k], d

    def run(batches):
        key, parts = None, []
        found: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*found, strict=True)], names=["s", "t", "rank"])

        def group():
            if key is not None and sum(len(p[0]) for p in parts) > 1:
                s, n, c, tile = (np.concatenate([p[k] for p in parts]) for k in range(4))
                bits, shown = ([x for p in parts for x in p[k]] for k in (4, 5))
                yield from tile_pairs(int(key[0]), s, n, c, tile, bits, shown, key[1] == key[2])

        def done():
            nonlocal found, size
            for x in group():
                found.append(x)
                size += len(x[0])
                if size >= FOUND:
                    yield flush()
                    found, size = [], 0

        for batch in batches:
            h, t0, t1, s, n, c, tile = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(7))
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (t0[1:] != t0[:-1]) | (t1[1:] != t1[:-1])
            cut = [*np.flatnonzero(new).tolist(), len(h)]
            for a, b in zip(cut, cut[1:], strict=False):
                this = (h[a], t0[a], t1[a])
                if this != key:
                    yield from done()
                    key, parts = this, []
                parts.append((s[a:b], n[a:b], c[a:b], tile[a:b], batch.column(7).slice(a, b - a).to_pylist(), batch.column(8).slice(a, b - a).to_pylist()))
        yield from done()
        if found:
            yield flush()

    met = dealt.mapInArrow(released(run), "s bigint, t bigint, rank bigint")
    return _few_each(met, nearest) if nearest else met.select(F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b"))


class Forest:
    """Links that join two trees of those before; whatever is linked stays linked by them."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = parent[x]
        return x

    def joins(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.parent[a] = b
        return a != b


def _bloom(spark: SparkSession, hashes: DataFrame):
    """A broadcast Bloom filter of fixed size of a column of hashes. Where it fills up it only lets more through."""

    def run(batches):
        bits = np.zeros(1 << (BLOOM_BITS - 3), np.uint8)
        for batch in batches:
            for k in _places(batch.column(0).to_numpy().view(np.uint64)):
                np.bitwise_or.at(bits, k >> 3, np.uint8(1) << (k & 7).astype(np.uint8))
        size = 1 << (BLOOM_BITS - 3 - 3)
        for k in range(8):
            part = bits[k * size : (k + 1) * size]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], names=["slice", "raw"])

    bits = np.zeros(1 << (BLOOM_BITS - 3), np.uint8)
    size = len(bits) // 8
    for k, x in _summed_slices(hashes.mapInArrow(released(run), "slice int, raw binary"), 8, "bits"):
        bits[k * size : (k + 1) * size] = x
    return spark.sparkContext.broadcast(bits)


def _places(x: np.ndarray):
    h = mix(x + np.uint64(0x51))
    for shift in (0, 26, 38):
        yield ((h >> np.uint64(shift)) & np.uint64((1 << BLOOM_BITS) - 1)).astype(np.int64)


def _compared(spark: SparkSession, scratch: Scratch, docs: DataFrame, sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) of set signatures, those whose sets are as similar as asked; each task leaves out links that its others imply."""
    sized = (
        pairs.join(sets.select(F.col("s").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a"), F.col("rep").alias("rep_a")), "a")
        .join(sets.select(F.col("s").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b"), F.col("rep").alias("rep_b")), "b")
    )

    def bounded(batches):
        for batch in batches:
            n_a, n_b, bits_a, bits_b = (batch.column(k).to_pylist() for k in range(4, 8))
            # Jaccard p% or more: the difference is at most (100 - p) / (100 + p) of both sizes
            keep = [(100 + percent) * least_difference(x, y) <= (100 - percent) * (m + n) for m, n, x, y in zip(n_a, n_b, bits_a, bits_b, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(4)], names=["a", "b", "rep_a", "rep_b"]).filter(pa.array(keep, pa.bool_()))

    id_type = docs.schema["doc_id"].dataType.simpleString()
    left = sized.select("a", "b", "rep_a", "rep_b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(released(bounded), f"a bigint, b bigint, rep_a {id_type}, rep_b {id_type}")
    left = scratch.table(left, "ngram-bounded")
    wanted = scratch.table(left.select(F.col("a").alias("s"), F.col("rep_a").alias("rep")).union(left.select("b", "rep_b")).distinct(), "ngram-wanted")
    bloom = _bloom(spark, wanted.select(F.xxhash64("rep")))

    def arrays(batches):
        bits = bloom.value
        for batch in batches:
            there = np.ones(batch.num_rows, bool)
            for k in _places(batch.column(2).to_numpy().view(np.uint64)):
                there &= (bits[k >> 3] >> (k & 7).astype(np.uint8)) & 1 == 1
            picked = batch.filter(pa.array(there))
            texts = text_array(picked.column(1))
            for i, j in slices(texts):
                found = [s for _, s in shingle_sets(Words(texts, i, j, lower=True))]
                yield pa.RecordBatch.from_arrays(
                    [picked.column(0).slice(i, j - i), pa.array([_signature(s) if len(s) else None for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], names=["doc_id", "s", "grams"]
                )

    grams = docs.select("doc_id", "text", F.xxhash64("doc_id")).mapInArrow(released(arrays), f"doc_id {id_type}, s bigint, grams binary")
    grams = grams.join(wanted, (grams.s == wanted.s) & grams.doc_id.eqNullSafe(wanted.rep)).select(grams.s, "grams")
    grams = scratch.table(grams, "ngram-arrays", codec="none")

    def whole(batches):
        forest = Forest()
        for batch in batches:
            keep = []
            for a, b, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate((x, y))
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common) and forest.joins(a, b))
            if len(forest.parent) > 1 << 20:
                forest = Forest()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs = left.join(grams.select(F.col("s").alias("a"), F.col("grams").alias("grams_a")), "a").join(grams.select(F.col("s").alias("b"), F.col("grams").alias("grams_b")), "b")
    links = scratch.table(pairs.select("a", "b", "grams_a", "grams_b").mapInArrow(released(whole), "a bigint, b bigint"), "ngram-links")
    scratch.drop(left, wanted, grams)
    bloom.destroy()
    return links


def _members(spark: SparkSession, df: DataFrame, text: str, id_col: str, percent: int) -> DataFrame:
    """doc_id, n_shingles and c: the set's component, by the least signature in it; null for an empty set."""
    docs = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    scratch = Scratch(spark)
    table = _set_table(scratch, docs)
    sets = table.where("s IS NOT NULL").groupBy("s").agg(F.first("n").alias("n"), F.first("bits", ignorenulls=True).alias("bits"), F.min("doc_id").alias("rep"))
    sets = scratch.table(sets, "ngram-rows")
    columns = _shared_columns(spark, scratch, docs, percent)
    lists = columns.where("h IS NOT NULL").select("h", "s", "n", F.col("s").alias("c"))
    found: DataFrame | None = None
    comps: DataFrame | None = None
    for turn in ("hubs", "nearest", "all"):
        if turn == "hubs":
            pairs = _hub_pairs(lists, HUBS, percent).union(columns.where("h IS NULL").select("s", "t"))
        else:
            pairs = _remaining_pairs(spark, lists, sets, percent, NEAREST if turn == "nearest" else 0)
        pairs = scratch.table(pairs.distinct(), "ngram-pairs")
        if pairs.isEmpty():
            continue
        links = _compared(spark, scratch, docs, sets, pairs, percent)
        scratch.drop(pairs)
        found = links if found is None else found.union(links)
        comps = components(scratch, found)
        if turn != "all":
            lists = columns.where("h IS NOT NULL").join(comps.withColumnRenamed("node", "s"), "s", "left").select("h", "s", "n", F.coalesce("component", "s").alias("c"))
            mixed = lists.groupBy("h").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").select("h")
            lists = scratch.table(with_state(lists, mixed, ["h"], F.col("s")), "ngram-lists")
    members = table.select("doc_id", F.col("n").alias("n_shingles"), "s")
    if comps is not None:
        members = members.join(comps.withColumnRenamed("node", "s"), "s", "left").select("doc_id", "n_shingles", F.coalesce("component", "s").alias("c"))
    else:
        members = members.withColumnRenamed("s", "c")
    members = scratch.table(members, "ngram-members")
    scratch.drop_but(members)
    return members


def similar_components(spark: SparkSession, df: DataFrame, text: str = "text", id_col: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (the least id reachable by links, its own included) of every row.

    A null or empty text, or one without words, has an empty set and is linked with nothing. Rows with equal
    sets are linked, repeated rows too. Null ids are allowed: they count as no id when a component's least one
    is taken, and a component of such rows alone has null. An empty table gives an empty result; columns other
    than id and text aren't read. Sets are told apart by 64-bit hashes of n-grams and of whole sets.
    """
    with arrow_batches(spark, BATCH):
        members = _members(spark, df, text, id_col, percent)
    least = members.where("c IS NOT NULL").groupBy("c").agg(F.min("doc_id").alias("least"))
    return members.join(least, "c", "left").select("doc_id", "n_shingles", F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


JOIN_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM words, unnest(range(1, greatest(len(w) - 3, 2))) AS r(i) WHERE len(w) > 0
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least_id AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS least_id FROM reach GROUP BY a) USING (doc_id)
"""
