"""Document fingerprints by Order MinHash.

Every occurrence of a k-mer of code points is numbered (first, second, ... in its text). For each of
COMPONENTS hash functions the PICKED occurrences of least hash are selected, put in text order, and their
k-mers hashed as a tuple. Two texts agree in a component only if they select the same k-mers in the same
order, so the share of equal components falls with edit distance, and not with set overlap alone.

All occurrences are ranked for each hash function, in blocks of BLOCK ranks. Only ranks under a bound that lets
some RANKED of them through are compared; a text where too few come through is ranked again without a bound.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.session import work_table
from .textscan import mix, text_array

K = 8
COMPONENTS = 32
PICKED = 2
BLOCK = 1 << 15
RANKED = 16
_STEP = np.uint64(0xD1342543DE82EF95)
_STEPS = [np.uint64(pow(0xD1342543DE82EF95, w, 1 << 64)) for w in (1, 2, 4)]
_SEEDS = mix(np.arange(1, COMPONENTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _kmers(points: np.ndarray) -> np.ndarray:
    """Hashes of the k-mers; a text shorter than K is one k-mer."""
    x = points.astype(np.uint64) + np.uint64(1)
    n = len(x) - K + 1
    if n <= 0:
        out = np.zeros(1, np.uint64)
        for v in x:
            out = out * _STEP + v
        return mix(out)
    # doubling: the hash of 2j code points from those of j
    h, width = x, 1
    for step in _STEPS:
        h = h[: len(h) - width] * step + h[width:]
        width *= 2
    return mix(h[:n])


def _numbered(h: np.ndarray) -> np.ndarray:
    """How many equal values stand before each."""
    # sorting by high bits with positions below them is much faster than a stable argsort
    low = np.uint64((1 << len(h).bit_length()) - 1)
    order = (np.sort((h & ~low) | np.arange(len(h), dtype=np.uint64)) & low).view(np.int64)
    s = h[order]
    begin = np.concatenate(([True], s[1:] != s[:-1]))
    high = s & ~low
    if (begin[1:] & (high[1:] == high[:-1])).any():
        order = np.argsort(h, kind="stable")
        s = h[order]
        begin[1:] = s[1:] != s[:-1]
    out = np.zeros(len(s), np.uint64)
    # only repeats get another number than 0
    again = np.flatnonzero(~begin)
    if len(again):
        first = np.flatnonzero(begin)
        out[order[again]] = (again - first[np.searchsorted(first, again) - 1]).astype(np.uint64)
    return out


def _least(keyed: np.ndarray, ranked: int) -> tuple[np.ndarray, np.ndarray]:
    """For each seed the positions of the least and second least of mix(keyed ^ seed), equal ones by position; two positions at least."""
    n = len(keyed)
    a, b = np.empty(COMPONENTS, np.int64), np.empty(COMPONENTS, np.int64)
    todo = np.arange(COMPONENTS)
    # the last step of mix() keeps the upper 31 bits: a bound of which only these are set can be held against the step before
    bound = (((1 << 64) // n * ranked) >> 33) << 33
    if n > BLOCK // COMPONENTS and 0 < bound < 1 << 64:
        # the first step of mix() goes over exclusive or
        x, seeds = keyed ^ (keyed >> np.uint64(30)), (_SEEDS ^ (_SEEDS >> np.uint64(30)))[:, None]
        width = min(n, BLOCK)
        height = max(1, BLOCK // width)
        ranks, other = np.empty((height, width), np.uint64), np.empty((height, width), np.uint64)
        under = np.empty((height, width), bool)
        rows, places, values = [], [], []
        for lo in range(0, COMPONENTS, height):
            for at in range(0, n, width):
                part = x[None, at : at + width]
                cut = (slice(min(height, COMPONENTS - lo)), slice(part.shape[1]))
                r, o, u = ranks[cut], other[cut], under[cut]
                np.bitwise_xor(part, seeds[lo : lo + height], out=r)
                np.multiply(r, np.uint64(0xBF58476D1CE4E5B9), out=r)
                np.right_shift(r, np.uint64(27), out=o)
                np.bitwise_xor(r, o, out=r)
                np.multiply(r, np.uint64(0x94D049BB133111EB), out=r)
                np.less(r, np.uint64(bound), out=u)
                i, j = np.nonzero(u)
                rows.append(i + lo)
                places.append(j + at)
                values.append(r[i, j])
        row, place, value = np.concatenate(rows), np.concatenate(places), np.concatenate(values)
        value ^= value >> np.uint64(31)
        order = np.lexsort((place, value, row))
        count = np.bincount(row, minlength=COMPONENTS)
        top, enough = np.cumsum(count) - count, count >= PICKED
        a[enough], b[enough] = place[order[top[enough]]], place[order[top[enough] + 1]]
        todo = np.flatnonzero(~enough)
    block = max(1, BLOCK // n)
    for lo in range(0, len(todo), block):
        which = todo[lo : lo + block]
        ranks = mix(keyed[None, :] ^ _SEEDS[which, None])
        a[which] = ranks.argmin(axis=1)
        ranks[np.arange(len(which)), a[which]] = np.uint64(0xFFFFFFFFFFFFFFFF)
        b[which] = ranks.argmin(axis=1)
    return a, b


def signature(points: np.ndarray) -> np.ndarray:
    """COMPONENTS 32-bit numbers of a text given by its code points; zeros for an empty one."""
    if not len(points):
        return np.zeros(COMPONENTS, np.uint32)
    h = _kmers(points)
    if len(h) == 1:
        return (mix(h[0] + _SEEDS) >> np.uint64(32)).astype(np.uint32)
    a, b = _least(h + _numbered(h) * np.uint64(0xA0761D6478BD642F), RANKED)
    first, second = np.minimum(a, b), np.maximum(a, b)
    return (mix(h[first] * _STEP + h[second] + _SEEDS) >> np.uint64(32)).astype(np.uint32)


def points_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def hexed(s: np.ndarray) -> str:
    return s.astype(">u4").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The last quarter (rounded down) replaced by the first as many code points of the following text."""
    e = len(text) // 4
    return text[: len(text) - e] + following[:e]


def _row(doc_id, text: str, sign: np.ndarray, following: str, next_sign: np.ndarray) -> tuple:
    changed = edited(text, following)
    other = sign if changed == text else signature(points_of(changed))
    return (doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), hexed(sign), hexed(other), likeness(sign, other), likeness(sign, next_sign))


_RESULT = "doc_id {}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_TYPES = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def fingerprints(df: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id and fingerprint of each row, null texts as empty ones; one pass, no shuffle."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = text_array(batch.column(1))
            prints = [hexed(signature(points_of(x.as_py()))) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.string())], names=["doc_id", "fingerprint"])

    return df.select(f"`{id_col}`", f"`{text}`").mapInArrow(run, f"doc_id {kind}, fingerprint string")


def edited_neighbours(spark: SparkSession, df: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Each document's fingerprint, that of its text edited with the next document's, and both likenesses.

    Next: in ascending id (null ids first, equal ids by a hash of their text, then by text), after the last
    the first; a single document is its own next. Null texts are empty: their fingerprint is all zeros, equal
    to that of any other empty text. Texts move once, dealt out by ranges of ids; neighbours over the border
    of two ranges meet in a small second step. Repeated rows are neighbours of each other.
    """
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = rows.withColumn("salt", F.xxhash64("text"))
    dealt = rows.repartitionByRange("doc_id", "salt").sortWithinPartitions("doc_id", "salt", "text").select("doc_id", "text")

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        id_type = None
        held = None

        def table(done: list[tuple], edges: list[tuple]) -> pa.RecordBatch:
            rows = done + [(e[0], *[None] * 6) for e in edges]
            cols = list(zip(*rows, strict=True))
            n = len(done)
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], id_type), *[pa.array(c, t) for c, t in zip(cols[1:], _TYPES, strict=True)]]
                + [pa.array([part] * len(rows), pa.int32()), pa.array([None] * n + [e[1] for e in edges], pa.string()), pa.array([None] * n + [e[2] for e in edges], pa.string())],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "part", "edge", "text"],
            )

        for batch in batches:
            id_type = batch.column(0).type
            done, edges = [], []
            for i, t in zip(batch.column(0).to_pylist(), text_array(batch.column(1)), strict=True):
                t = t.as_py()
                sign = signature(points_of(t))
                if held is None:
                    edges.append((i, "first", t))
                else:
                    done.append(_row(*held, t, sign))
                held = (i, t, sign)
                if len(done) >= 500:
                    yield table(done, edges)
                    done, edges = [], []
            if done or edges:
                yield table(done, edges)
        if held is not None:
            yield table([], [(held[0], "last", held[1])])

    both = work_table(spark, dealt.mapInArrow(run, _RESULT.format(kind) + ", part int, edge string, text string"), "order-minhash")
    inner = both.where("edge IS NULL").drop("part", "edge", "text")
    # one row for each range that has rows: the range after it, the first one after the last
    parts = both.where("edge = 'first'").select("part")
    over = W.orderBy("part")
    parts = parts.select("part", F.coalesce(F.lead("part").over(over), F.min("part").over(W.partitionBy())).alias("next_part"))
    last = both.where("edge = 'last'").select("doc_id", "text", "part")
    first = both.where("edge = 'first'").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"))
    pairs = last.join(parts, "part").join(first, "next_part").select("doc_id", "text", "next_text")

    def border(batches):
        for batch in batches:
            out = []
            for i, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out.append(_row(i, a, signature(points_of(a)), b, signature(points_of(b))))
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.column(0).type), *[pa.array(c, t) for c, t in zip(cols[1:], _TYPES, strict=True)]], names=inner_names)

    inner_names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return inner.unionByName(pairs.mapInArrow(border, _RESULT.format(kind)))
