"""The driver's tables as updates, registries and logs, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import read_table


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """embeddings: (grp = label, client = vec_id, param, idx, value, w, steps)."""
    e = read_table(spark, d, "embeddings")
    return e.select(
        F.col("label").alias("grp"), F.col("vec_id").alias("client"), (1 + F.col("vec_id") % 3).cast("double").alias("w"), (1 + F.col("vec_id") % 5).cast("int").alias("steps"),
        F.posexplode("embedding").alias("idx", "_v"),
    ).select("grp", "client", F.lit("embedding").alias("param"), "idx", F.col("_v").cast("double").alias("value"), "w", "steps")


def label_means(spark: SparkSession, d: str) -> DataFrame:
    """embeddings: ten clients (labels) of one group, the mean of their vectors, weighted by their number."""
    v = vectors(spark, d)
    return v.groupBy(F.col("grp").alias("client"), "idx").agg(F.avg("value").alias("value"), F.count("*").cast("double").alias("w")).withColumn("grp", F.lit(0)).withColumn("param", F.lit("embedding"))


def lines(spark: SparkSession, d: str) -> DataFrame:
    """lineitem: a client (supplier) of a round (ship month), a parameter for flag and status, four coordinates."""
    x = read_table(spark, d, "lineitem")
    month = (F.year("l_shipdate") * 100 + F.month("l_shipdate")).cast("int")
    g = x.groupBy(month.alias("grp"), F.col("l_suppkey").alias("client"), F.concat("l_returnflag", "l_linestatus").alias("param")).agg(
        *[F.avg(c).alias(f"v{i}") for i, c in enumerate(("l_quantity", "l_extendedprice", "l_discount", "l_tax"))], F.count("*").cast("double").alias("w"), F.count_distinct("l_linenumber").cast("int").alias("steps")
    )
    return g.select("grp", "client", "param", F.posexplode(F.array("v0", "v1", "v2", "v3")).alias("idx", "value"), "w", "steps")


def daily(spark: SparkSession, d: str) -> DataFrame:
    """events: (round = day number, client = user, param = type, idx 0, value = mean, w = count)."""
    e = read_table(spark, d, "events")
    day = F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date"))
    return e.groupBy(day.alias("round"), F.col("user_id").alias("client"), F.col("event_type").alias("param")).agg(F.avg("value").alias("value"), F.count("*").cast("double").alias("w")).withColumn("idx", F.lit(0))


def deltas(spark: SparkSession, d: str) -> DataFrame:
    """events: (param, round, value): a round's weighted mean."""
    x = daily(spark, d)
    return x.groupBy("param", "round").agg((F.sum(F.col("value") * F.col("w")) / F.sum("w")).alias("value"))


def registry(spark: SparkSession, d: str) -> DataFrame:
    """customer: (client, enabled, weight)."""
    x = read_table(spark, d, "customer")
    return x.select(F.col("c_custkey").alias("client"), (F.col("c_nationkey") % 5 != 0).alias("enabled"), (F.greatest(F.col("c_acctbal"), F.lit(0.0)) + 1).alias("weight"))


SQL = {
    "b1": """b1 AS (
  SELECT label AS grp, vec_id AS client, 'embedding' AS param, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS idx, CAST(unnest(embedding) AS DOUBLE) AS value,
         CAST(1 + vec_id % 3 AS DOUBLE) AS w, CAST(1 + vec_id % 5 AS INT) AS steps FROM embeddings)""",
    "b2": "b2 AS (SELECT grp AS client, idx, avg(value) AS value, CAST(count(*) AS DOUBLE) AS w, 0 AS grp, 'embedding' AS param FROM b1 GROUP BY grp, idx)",
    "b3": """b3g AS (
  SELECT CAST(year(l_shipdate) * 100 + month(l_shipdate) AS INT) AS grp, l_suppkey AS client, l_returnflag || l_linestatus AS param,
         [avg(l_quantity), avg(l_extendedprice), avg(l_discount), avg(l_tax)] AS vs, CAST(count(*) AS DOUBLE) AS w, CAST(count(DISTINCT l_linenumber) AS INT) AS steps
  FROM lineitem GROUP BY ALL),
b3 AS (SELECT grp, client, param, CAST(generate_subscripts(vs, 1) - 1 AS INT) AS idx, unnest(vs) AS value, w, steps FROM b3g)""",
    "b4": """b4 AS (
  SELECT CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INT) AS round, user_id AS client, event_type AS param, avg(value) AS value, CAST(count(*) AS DOUBLE) AS w, 0 AS idx
  FROM events GROUP BY ALL)""",
    "deltas": "deltas AS (SELECT param, round, sum(value * w) / sum(w) AS value, row_number() OVER (PARTITION BY param ORDER BY round) AS t FROM b4 GROUP BY param, round)",
    "registry": "registry AS (SELECT c_custkey AS client, c_nationkey % 5 <> 0 AS enabled, greatest(c_acctbal, 0.0) + 1 AS weight FROM customer)",
}


def with_sql(*names: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(SQL[n] for n in names)
