"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Each source's documents are shuffled by a hash of their ids and stand in a queue that repeats up to
MAX_REPEATS times. A document's virtual finish time is its source's cumulative words, its own included,
divided by the source's target. All documents are then put in order of that time and taken as long as the
running total stays within the budget.

No step orders a whole source, all sources or a table in one task. Queues are cut by hash prefix, and the line of times, however
long, into COARSE x FINE pieces of 1 - 1 / (1 + time): a small table of sums for each piece gives what lies
before it, and only within a piece are rows ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.session import work_table

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
PREFIX = 3  # hex digits: 4,096 pieces of each source's queue
COARSE, FINE = 8192, 1024  # pieces of the line of times, and of one of them
WORD = r"[^\x20\x09-\x0D]+"


def _in_order(spark: SparkSession, rows: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """rows with, for each name in sums, the sum of that column over the rows before each in this order.

    Rows are dealt by ranges of the order; a table with a row for each range has what lies before it, and only within
    a range are rows ordered. Which range a row is in is written, so that both sides see the same.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = work_table(spark, rows.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "mix-sources")
    line = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # a row for each range
    ranges = dealt.groupBy("_range").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    ranges = ranges.select("_range", *[F.coalesce(F.sum(f"_{n}").over(line), F.lit(0)).alias(f"_{n}") for n in sums])
    within = W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = dealt.withColumns({f"_in_{n}": F.coalesce(F.sum(c).over(within), F.lit(0)) for n, c in sums.items()}).join(F.broadcast(ranges), "_range")
    return out.withColumns({n: F.col(f"_{n}") + F.col(f"_in_{n}") for n in sums}).drop("_range", *[f"_{n}" for n in sums], *[f"_in_{n}" for n in sums])


def source_targets(spark: SparkSession, sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """Of rows (skey, snull, source_size), one for each source: also target and budget.

    Sources in code-point order, null last, have the weights in turn and share the sum of all sizes. A target
    stops at repeats times its source's size; the rest is shared by weight again until none is above. Sources
    are ordered by the level at which they stop, so running sums give the last round at once. No task orders all
    sources; sums of sizes and weights are of whole numbers, so they don't depend on how sources are dealt.
    """
    rows = _in_order(spark, sizes.withColumn("one", F.lit(1).cast("bigint")), [F.col("snull").asc(), F.col("skey").asc()], {"turn": "one"})
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("turn") % len(weights) + 1).cast("int"))
    rows = rows.select("skey", "snull", "source_size", w.cast("double").alias("w"), (F.col("source_size") * repeats).cast("double").alias("cap"))
    rows = rows.withColumn("ratio", F.col("cap") / F.col("w"))
    rows = _in_order(spark, rows, [F.col("ratio").asc(), F.col("snull").asc(), F.col("skey").asc()], {"before_cap": "cap", "before_w": "w"})
    one = rows.groupBy().agg(F.sum("source_size").alias("budget"), F.sum("w").alias("all_w"))
    rows = rows.join(F.broadcast(one))
    rows = rows.withColumn("level", (F.col("budget") - F.col("before_cap")) / (F.col("all_w") - F.col("before_w")))
    rows = work_table(spark, rows.withColumn("stops", F.col("cap") <= F.col("w") * F.col("level")), "mix-levels")
    held = F.coalesce(F.sum(F.when(F.col("stops"), F.col("cap"))), F.lit(0.0))
    free = F.coalesce(F.sum(F.when(~F.col("stops"), F.col("w"))), F.lit(0.0))
    rows = rows.join(F.broadcast(rows.groupBy().agg(held.alias("held"), free.alias("free"))))
    target = F.when(F.col("stops"), F.col("cap")).otherwise((F.col("budget") - F.col("held")) * F.col("w") / F.col("free"))
    return rows.select("skey", "snull", "source_size", target.alias("target"), "budget")


def mix_sources(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target and taken (words that the mix takes, repeats counted), and the columns to carry.

    A null or empty text has size 0 and nothing is taken of it; a null source is a source, the last. Documents
    are shuffled by a hash of id and text, in which nulls count as empty. Repeated rows are documents of their
    own; among equal ones it makes no difference which is taken. No document is taken more than MAX_REPEATS
    times, however late its time may be. An empty table gives an empty result. Results depend on ids, texts
    and sources alone, not on the partitioning.
    """
    c = lambda n: F.col(f"`{n}`")
    sized = docs.select(
        c(id_col).alias("doc_id"),
        *[c(n) for n in carry],
        F.coalesce(F.regexp_count(c(text), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        F.coalesce(c(source), F.lit("")).alias("skey"),
        c(source).isNull().alias("snull"),
        F.md5(F.concat_ws(":", F.coalesce(c(id_col).cast("string"), F.lit("")), F.md5(F.coalesce(c(text), F.lit("")).cast("binary"))).cast("binary")).alias("shuffled"),
    ).withColumn("piece", F.substring("shuffled", 1, PREFIX))
    sized = work_table(spark, sized, "mix-sized")
    pieces = sized.groupBy("skey", "snull", "piece").agg(F.sum("size").alias("piece_size"))
    targets = source_targets(spark, sized.groupBy("skey", "snull").agg(F.sum("size").alias("source_size")))
    earlier = W.partitionBy("skey", "snull").orderBy("piece").rowsBetween(W.unboundedPreceding, -1)
    pieces = pieces.withColumn("before", F.coalesce(F.sum("piece_size").over(earlier), F.lit(0))).drop("piece_size")
    pieces = pieces.join(targets, ["skey", "snull"])
    queue = W.partitionBy("skey", "snull", "piece").orderBy("shuffled", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    within = sized.withColumn("within", F.sum("size").over(queue))
    items = within.join(pieces, ["skey", "snull", "piece"]).withColumn("cumulative", F.col("before") + F.col("within"))
    items = work_table(spark, items.drop("before", "within", "piece"), "mix-items")

    def time(turn: Column | int) -> Column:
        return (F.col("cumulative") + turn * F.col("source_size")).cast("double") / F.nullif(F.col("target"), F.lit(0.0))

    def piece(t: Column, pieces: int) -> Column:
        """Each operation keeps the order, rounding included."""
        return F.floor((1 - 1 / (1 + t)) * pieces)

    turns = F.sequence(F.lit(0), F.lit(MAX_REPEATS - 1))
    queued = items.where("size > 0").select("doc_id", "skey", "snull", "shuffled", "size", "cumulative", "source_size", "target", "budget", F.explode(turns).alias("turn")).withColumn("time", time(F.col("turn")))
    coarse = piece(F.col("time"), COARSE)
    fine = piece(F.col("time"), COARSE * FINE)

    def crossed(rows: DataFrame, cut: Column, before: Column) -> DataFrame:
        """The first piece of time that doesn't fit into the budget as a whole, and the words before it; no row if all fit."""
        sums = rows.groupBy(cut.alias("cut")).agg(F.sum("size").alias("n"), F.max("budget").alias("budget"), before.alias("start"))
        running = F.col("start") + F.sum("n").over(W.orderBy("cut"))
        return sums.withColumn("running", running).where("running > budget").groupBy().agg(F.min("cut").alias("cut"), F.min_by(F.col("running") - F.col("n"), "cut").alias("start")).where("cut IS NOT NULL")

    # both tables below have one row at most
    first = crossed(queued, coarse, F.lit(0).cast("bigint"))
    first = work_table(spark, first.withColumnRenamed("cut", "coarse_cut").withColumnRenamed("start", "coarse_start"), "mix-cut")
    inside = queued.join(F.broadcast(first), coarse == F.col("coarse_cut"))
    second = work_table(spark, crossed(inside, fine, F.max("coarse_start")).withColumnRenamed("cut", "fine_cut"), "mix-cut")
    last = inside.join(F.broadcast(second), fine == F.col("fine_cut"))
    order = W.partitionBy("fine_cut").orderBy("time", "snull", "skey", "shuffled", "doc_id", "turn").rowsBetween(W.unboundedPreceding, 0)
    fits = last.withColumn("running", F.col("start") + F.sum("size").over(order)).where("running <= budget")
    # where the order reaches: the last (time, source, hash) that fits within the piece, if any
    edge = fits.groupBy().agg(F.max(F.struct("time", "snull", "skey", "shuffled", "doc_id", "turn")).alias("edge"))
    edge = work_table(spark, edge, "mix-edge")
    cut = second.select("fine_cut").unionByName(spark.createDataFrame([(None,)], "fine_cut bigint")).groupBy().agg(F.max("fine_cut").alias("fine_cut"))
    limits = cut.join(F.broadcast(edge), how="left", on=F.lit(True))

    def taken(turn: int) -> Column:
        t = time(turn)
        here = F.struct(t.alias("time"), F.col("snull"), F.col("skey"), F.col("shuffled"), F.col("doc_id"), F.lit(turn).alias("turn"))
        at = piece(t, COARSE * FINE)
        return F.when(F.col("fine_cut").isNull() | (at < F.col("fine_cut")) | ((at == F.col("fine_cut")) & F.coalesce(here <= F.col("edge"), F.lit(False))), F.col("size")).otherwise(F.lit(0))

    total = sum((taken(e) for e in range(1, MAX_REPEATS)), taken(0))
    out = items.join(F.broadcast(limits), how="left", on=F.lit(True))
    return out.select("doc_id", "size", "source_size", "target", F.when(F.col("size") > 0, total).otherwise(F.lit(0)).cast("bigint").alias("taken"), *[c(n) for n in carry])


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         coalesce(source, '') AS skey, source IS NULL AS snull, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS shuffled
  FROM documents
), summed AS (
  SELECT skey, snull, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY skey, snull
), sources AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + (row_number() OVER (ORDER BY snull, skey) - 1) % 3] AS w FROM summed
), caps AS (
  SELECT *, CAST(source_size * 3 AS DOUBLE) AS cap, CAST(sum(source_size) OVER () AS BIGINT) AS budget, sum(w) OVER () AS all_w FROM sources
), levels AS (
  SELECT *, (budget - coalesce(sum(cap) OVER prior, 0)) / (all_w - coalesce(sum(w) OVER prior, 0)) AS level
  FROM caps WINDOW prior AS (ORDER BY cap / w, snull, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), stopped AS (
  SELECT *, cap <= w * level AS stops FROM levels
), targets AS (
  SELECT skey, snull, source_size, budget,
         CASE WHEN stops THEN cap ELSE (budget - coalesce(sum(cap) FILTER (stops) OVER (), 0)) * w / sum(w) FILTER (NOT stops) OVER () END AS target
  FROM stopped
), queued AS (
  SELECT s.*, t.source_size, t.target, t.budget,
         sum(size) OVER (PARTITION BY s.skey, s.snull ORDER BY shuffled, doc_id, size ROWS UNBOUNDED PRECEDING) AS cumulative,
         row_number() OVER () AS row_id
  FROM sized s JOIN targets t ON s.skey = t.skey AND s.snull = t.snull
), timed AS (
  SELECT q.*, turn, CAST(cumulative + turn * source_size AS DOUBLE) / target AS finish
  FROM queued q, (SELECT unnest([0, 1, 2]) AS turn) WHERE size > 0
), running AS (
  SELECT *, sum(size) OVER (ORDER BY finish, snull, skey, shuffled, doc_id, turn ROWS UNBOUNDED PRECEDING) AS total FROM timed
), chosen AS (
  SELECT row_id, CAST(sum(size) AS BIGINT) AS taken FROM running WHERE total <= budget GROUP BY row_id
)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM queued LEFT JOIN chosen USING (row_id)
"""
