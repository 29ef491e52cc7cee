"""Ranked lexical search: an index of documents in shards, searched by block-max WAND with blocks of variable length.

Index, in two passes: a shard is a stretch of documents with the postings of all its terms; when the corpus sums
are known, each posting gets its impact (what it scores for a weight of 1), and dynamic programming cuts each
posting list into blocks: of all cuts into blocks of LONGEST postings at most, one for which the error of the bounds
(block maximum less impact, over all postings) plus BLOCK_COST for each block is least. Lists of more than PIECE
postings are cut there first. A shard is one row of a table, so building and searching move no posting.

Search: a document's bound is the sum of the maxima of the blocks that span it. Only documents whose bound reaches
the least score of the best k so far, and that stand in a list without which the maxima of lists don't reach it,
are pivots; blocks without a pivot are never looked into, and pivots are scored exactly. A task keeps the best k of
each item over all its shards, so later shards skip more. Nothing is lost: a skipped document's score is below the
k-th.

Items are taken in blocks of about ITEM_BYTES of text, by hash, each of which is two passes over the index.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.session import Scratch, arrow_batches
from .textscan import ALNUM, Words, released, slices, text_array

TOP = 10
SHARD = 8 << 20
SHARD_ROWS = 1 << 16
LONGEST = 64
PIECE = 2048
BLOCK_COST = 200_000
ITEM_BYTES = 4 << 20
AT_ONCE = 2  # shards that a task is handed at once
ROW_GROUP = 8 << 20  # bytes after which a file's row group ends: of shards a task buffers no more, however many it has
TEXTS = 2000  # texts that a task is handed at once
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_FAR = np.int64(1) << 60
_SHARD_FIELDS = "terms array<string>, term_at binary, docs binary"


def item_terms(text: str | None) -> list[str]:
    """Different terms of an item."""
    return sorted(set(TERM.findall((text or "").translate(_LOWER))))


def postings(words: Words, letters: np.ndarray = ALNUM) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms, where each one's postings begin, rows, occurrences, terms of each row)."""
    size = words.end - words.start
    data = words.data[letters[words.data]]
    offsets = np.append(0, np.cumsum(size)).astype(np.int64)
    coded = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
    n = np.diff(words.first)
    if not len(size):
        return pa.array([], pa.string()), np.zeros(1, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32), n
    key = coded.indices.to_numpy().astype(np.int64) * words.rows + words.row
    key, tf = np.unique(key, return_counts=True)
    term = key // words.rows
    at = np.searchsorted(term, np.arange(len(coded.dictionary) + 1))
    return coded.dictionary.cast(pa.string()), at.astype(np.int32), (key % words.rows).astype(np.int32), tf.astype(np.int32), n


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """What a posting scores for a weight of 1, in whole numbers; n is its document's number of terms."""
    most = 90 * int(n.max(initial=0)) * documents
    scaled = 90 * n.astype(np.int64) * documents // total if most < 1 << 62 else np.array([90 * x * documents // total for x in n.tolist()], np.int64)
    tf = tf.astype(np.int64)
    return (1_000_000_000 * tf // (1000 * tf + 8 * (100 - 90 + scaled))).astype(np.int32)


def variable_blocks(score: np.ndarray, at: np.ndarray, longest: int = LONGEST, cost: int = BLOCK_COST, piece: int = PIECE, held: int = 16_384) -> tuple[np.ndarray, np.ndarray]:
    """Of lists score[at[i] : at[i + 1]]: the ends of their blocks, in order, and the maxima of these."""
    length = np.diff(at)
    pieces = -(-length // piece)
    begin = np.repeat(at[:-1], pieces) + piece * (np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    size = np.minimum(np.repeat(at[1:], pieces) - begin, piece).astype(np.int64)
    back = np.ones(len(score), np.int16)  # how long the last block of the best cut up to here is
    order = np.argsort(-size, kind="stable")
    order = order[size[order] > 1]
    for lo in range(0, len(order), held):
        part = order[lo : lo + held]
        start, n = begin[part].astype(np.int64), size[part]
        # columns are the last `longest` places where a block may begin, in a ring
        top = np.zeros((len(part), longest), np.int64)
        before = np.full((len(part), longest), _FAR)
        best = np.zeros(len(part), np.int64)
        active = len(part)
        for r in range(int(n[0])):
            while n[active - 1] <= r:
                active -= 1
            s = score[start[:active] + r].astype(np.int64)
            c = r % longest
            t, b = top[:active], before[:active]
            np.maximum(t, s[:, None], out=t)
            t[:, c] = s
            b[:, c] = best[:active]
            width = (r - np.arange(longest)) % longest + 1
            total = t * width
            total += b
            found = total.argmin(1)
            back[start[:active] + r] = width[found]
            best[:active] = total[np.arange(active), found] + cost
    ends = np.zeros(len(score), bool)
    place = (begin + size).astype(np.int64)
    while len(place):
        ends[place - 1] = True
        place = place - back[place - 1]
        more = place > begin
        place, begin = place[more], begin[more]
    end = np.flatnonzero(ends) + 1
    return end.astype(np.int32), (np.maximum.reduceat(score, np.append(0, end[:-1])) if len(end) else np.zeros(0, np.int32)).astype(np.int32)


class Shard:
    """A shard's terms, postings, impacts and blocks."""

    def __init__(self, ids: pa.Array, terms: pa.Array, term_at, docs, impact, block_at, block_end, block_top):
        self.ids, self.terms, self.term_at = ids, terms, term_at
        self.docs, self.impact = docs, impact
        self.block_at, self.block_end, self.block_top = block_at, block_end, block_top
        self.block_begin = np.append(0, block_end[:-1]).astype(np.int64) if len(block_end) else np.zeros(0, np.int64)
        self.looked = 0  # postings that were looked at
        self._place = np.full(len(ids), -1, np.int64)

    def _postings(self, pivots: np.ndarray, begin, end, first, last) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Those blocks that span a pivot, how long they are, and the places of their postings."""
        some = np.searchsorted(pivots, last, side="right") > np.searchsorted(pivots, first)
        n = (end - begin)[some]
        return some, n, np.repeat(begin[some] - np.append(0, np.cumsum(n))[:-1], n) + np.arange(int(n.sum()))

    def _scores(self, pivots: np.ndarray, begin, end, first, last, weight) -> np.ndarray:
        """Whole scores of pivots, from those blocks that span one."""
        some, n, at = self._postings(pivots, begin, end, first, last)
        self.looked += len(at)
        self._place[pivots] = np.arange(len(pivots))
        place = self._place[self.docs[at]]
        self._place[pivots] = -1
        met = place >= 0
        # sums stay far below 2^53
        score = self.impact[at[met]].astype(np.float64) * np.repeat(weight[some], n)[met]
        return np.bincount(place[met], score, len(pivots)).astype(np.int64)

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of all documents that may be among the best k: none whose score is below `least`, nor below k others here."""
        a, b = self.block_at[terms], self.block_at[terms + 1]
        n = (b - a).astype(np.int64)
        at = np.repeat(a - np.append(0, np.cumsum(n))[:-1], n) + np.arange(int(n.sum()))
        weight = np.repeat(weights, n)
        begin, end = self.block_begin[at], self.block_end[at].astype(np.int64)
        first, last = self.docs[begin].astype(np.int64), self.docs[end - 1].astype(np.int64)
        step = np.zeros(len(self.ids) + 1, np.int64)
        top = self.block_top[at] * weight
        np.add.at(step, first, top)
        np.subtract.at(step, last + 1, top)
        bound = np.cumsum(step)[:-1]
        list_top = np.maximum.reduceat(top, np.append(0, np.cumsum(n))[:-1])
        by_top = np.argsort(list_top, kind="stable")
        reach = np.zeros(len(terms), np.int64)
        reach[by_top] = np.cumsum(list_top[by_top])  # the maxima of a list and of all smaller ones
        pivots = np.flatnonzero(bound >= max(least, 1))
        rows, scores = [], []
        # first some in the lists of highest maxima, so that the others meet a higher threshold
        turns = (pivots,)
        if len(pivots) > 4 * k:
            early = np.zeros(len(self.ids), bool)
            for t in by_top[::-1].tolist():
                early[self.docs[self.term_at[terms[t]] : self.term_at[terms[t] + 1]]] = True
                if early.sum() >= k:
                    break
            early = early[pivots]
            some = np.flatnonzero(early)
            if len(some) > 4 * k:
                early[some[np.argpartition(-bound[pivots[some]], 4 * k)[4 * k :]]] = False
            turns = (pivots[early], pivots[~early])
        for turn in turns:
            turn = turn[bound[turn] >= max(least, 1)]
            if len(turn) and not (reach >= least).all():
                needed = np.repeat(reach >= least, n)
                there = np.zeros(len(self.ids), bool)
                there[self.docs[self._postings(turn, *(x[needed] for x in (begin, end, first, last)))[2]]] = True
                turn = turn[there[turn]]
            if not len(turn):
                continue
            found = self._scores(turn, begin, end, first, last, weight)
            keep = found >= max(least, 1)
            rows.append(turn[keep])
            scores.append(found[keep])
            got = np.concatenate(scores)
            if len(got) >= k:
                least = max(least, int(np.partition(got, len(got) - k)[len(got) - k]))
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        row, score = np.concatenate(rows), np.concatenate(scores)
        return row[score >= least], score[score >= least]


def _list(x: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)


def _binary(*arrays: np.ndarray) -> list[pa.Array]:
    return [pa.array([x.tobytes()], pa.binary()) for x in arrays]


def build_index(spark: SparkSession, docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, int, int]:
    """The index of (doc_id, text), the number of documents that have terms, and all their terms with repeats."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shard_size = SHARD

    def collect(batches):
        shard = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = text_array(batch.column(1))
            for i, j in slices(texts, shard_size):
                for lo in range(i, j, SHARD_ROWS):
                    hi = min(j, lo + SHARD_ROWS)
                    terms, at, rows, tf, n = postings(Words(texts, lo, hi, lower=True, letters=ALNUM))
                    full = np.flatnonzero(n)
                    if len(full):
                        new = np.cumsum(n > 0) - 1
                        ids = batch.column(0).slice(lo, hi - lo).take(pa.array(full))
                        cols = [pa.array([shard], pa.int64()), pa.array([len(full)], pa.int64()), pa.array([int(n.sum())], pa.int64()), _list(ids), _list(terms)]
                        cols += _binary(at, new[rows].astype(np.int32), tf, n[full].astype(np.int64))
                        yield pa.RecordBatch.from_arrays(cols, names=["shard", "documents", "total", "ids", "terms", "term_at", "docs", "tf", "n"])
                        shard += 1

    head = f"shard bigint, documents bigint, total bigint, ids array<{kind}>, {_SHARD_FIELDS}"
    with arrow_batches(spark, TEXTS):
        raw = scratch.table(docs.select("doc_id", "text").mapInArrow(released(collect), f"{head}, tf binary, n binary"), "lexical-postings", row_group=ROW_GROUP)
    sums = raw.agg(F.coalesce(F.sum("documents"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    documents, total = int(sums[0]), int(sums[1])

    def cut(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k] for name in ("term_at", "docs", "tf", "n")}
                at, rows, tf = (np.frombuffer(row[x].as_buffer(), np.int32) for x in ("term_at", "docs", "tf"))
                impact = impacts(tf, np.frombuffer(row["n"].as_buffer(), np.int64)[rows], documents, total)
                end, top = variable_blocks(impact, at)
                block_at = np.searchsorted(end, at, side="right").astype(np.int32)
                kept = batch.slice(k, 1)
                cols = [kept.column(x) for x in ("shard", "ids", "terms", "term_at", "docs")] + _binary(impact, block_at, end, top)
                yield pa.RecordBatch.from_arrays(cols, names=["shard", "ids", "terms", "term_at", "docs", "impact", "block_at", "block_end", "block_top"])

    with arrow_batches(spark, AT_ONCE):
        index = raw.mapInArrow(released(cut), f"shard bigint, ids array<{kind}>, {_SHARD_FIELDS}, impact binary, block_at binary, block_end binary, block_top binary")
        index = scratch.table(index, "lexical-index", row_group=ROW_GROUP)
    scratch.drop(raw)
    return index, documents, total


def shards(batches) -> Iterator[Shard]:
    for batch in batches:
        for k in range(batch.num_rows):
            ints = [np.frombuffer(batch.column(x)[k].as_buffer(), np.int32) for x in ("term_at", "docs", "impact", "block_at", "block_end", "block_top")]
            yield Shard(batch.column("ids")[k].values, batch.column("terms")[k].values, *ints)


def better(x: tuple) -> tuple:
    """Order of (score, id): higher scores first, then smaller ids, null last."""
    return -x[0], x[1] is None, x[1]


def search_index(spark: SparkSession, index: DataFrame, documents: int, items: list[list[str]], k: int) -> DataFrame:
    """(item, doc_id, score): of each item, by its place in the list of bounded length, the best k of each task."""
    vocabulary = sorted(set().union(*items))
    place = {t: i for i, t in enumerate(vocabulary)}
    wanted = spark.sparkContext.broadcast(vocabulary)

    def count(batches):
        terms = pa.array(wanted.value, pa.string())
        df = np.zeros(len(terms), np.int64)
        for batch in batches:
            for r in range(batch.num_rows):
                n = np.append(np.diff(np.frombuffer(batch.column(1)[r].as_buffer(), np.int32)), 0)
                df += n[pc.fill_null(pc.index_in(terms, value_set=batch.column(0)[r].values), len(n) - 1).to_numpy()]
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(df[some])], names=["term", "df"])

    counts = index.select("terms", "term_at").mapInArrow(released(count), "term int, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect()
    weight = np.zeros(len(vocabulary), np.int64)
    for term, df in counts:
        weight[term] = math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))
    asked = spark.sparkContext.broadcast((vocabulary, weight, [np.array([place[t] for t in x], np.int64) for x in items]))
    kind = index.schema["ids"].dataType.elementType.simpleString()

    def run(batches):
        terms, weights, lists = asked.value
        terms = pa.array(terms, pa.string())
        best: list[list[tuple]] = [[] for _ in lists]
        for shard in shards(batches):
            there = pc.fill_null(pc.index_in(terms, value_set=shard.terms), -1).to_numpy()
            for item, mine in enumerate(lists):
                mine = mine[(there[mine] >= 0) & (weights[mine] > 0)]
                if not len(mine):
                    continue
                held = best[item]
                rows, scores = shard.search(there[mine], weights[mine], k, held[-1][0] if len(held) == k else 0)
                if len(rows):
                    found = zip(scores.tolist(), shard.ids.take(pa.array(rows)).to_pylist(), strict=True)
                    best[item] = sorted([*held, *found], key=better)[:k]
        out = [(item, doc, score) for item, held in enumerate(best) for score, doc in held]
        cols = list(zip(*out, strict=True)) if out else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], index_type), pa.array(cols[2], pa.int64())], names=["item", "doc_id", "score"])

    from pyspark.sql.pandas.types import to_arrow_type

    index_type = to_arrow_type(index.schema["ids"].dataType.elementType)
    return index.drop("shard").mapInArrow(released(run), f"item int, doc_id {kind}, score bigint")


def rank_documents(spark: SparkSession, docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id and score: for each row of items the k documents of highest scores above 0, equal ones by ascending id (null last).

    Null and empty texts have no terms: such documents are never found and not counted, such items find nothing.
    Every row of either table stands for itself: repeated documents take ranks of their own, repeated items are
    ranked each for itself. Empty tables give an empty result; columns besides ids and texts aren't read.
    """
    c = lambda n: F.col(f"`{n}`")
    docs = docs.select(c(id_col).alias("doc_id"), c(text).alias("text"))
    items = items.select(c(item_col).alias("item_id"), c(item_text).alias("text"))
    scratch = Scratch(spark)
    index, documents, _ = build_index(spark, docs, scratch)
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = max(1, -(-size // ITEM_BYTES))
    items = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).cast("int"))
    kinds = (items.schema["item_id"].dataType.simpleString(), docs.schema["doc_id"].dataType.simpleString())
    out = None
    for block in range(blocks):
        rows = sorted(((r["item_id"], item_terms(r["text"])) for r in items.where(F.col("block") == block).collect()), key=lambda r: (r[0] is None, r[0], r[1]))
        with arrow_batches(spark, AT_ONCE):
            found = scratch.table(search_index(spark, index, documents, [t for _, t in rows], k), "lexical-found")
        order = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        named = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], f"item int, item_id {kinds[0]}")
        ranked = ranked.join(named, "item").select("item_id", "rank", "doc_id", "score")
        ranked = scratch.table(ranked, "lexical-ranked")
        scratch.drop(found)
        out = ranked if out is None else out.union(ranked)
    scratch.drop(index)
    return out


SEARCH_SQL = r"""
WITH tokens AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents
), docs AS (
  SELECT r, doc_id, t, CAST(len(t) AS BIGINT) AS n FROM tokens WHERE len(t) > 0
), sums AS (
  SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM docs
), tf AS (
  SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(t) AS term FROM docs) GROUP BY ALL
), df AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, sums GROUP BY term
), items AS (
  SELECT row_number() OVER () AS i, item_id, unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term
  FROM benchmark
), scored AS (
  SELECT i, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // total)))) AS BIGINT) AS score
  FROM items JOIN tf USING (term) JOIN df USING (term), sums GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0
)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
