"""Weights, checkpoints and logs as files, and the JSON form of weights."""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WEIGHTS = "round int, param string, idx int, value double"
_INDEX = "round int, folder string, at double, tables string"
_JSON = "map<string,array<double>>"


def save_weights(weights: DataFrame, path: str) -> None:
    """Parquet, a folder for each parameter: names come back as they were."""
    weights.write.mode("overwrite").partitionBy("param").parquet(path)


def load_weights(spark: SparkSession, path: str, schema: str = WEIGHTS) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def save_checkpoint(weights: DataFrame, path: str, round_: int) -> None:
    """One version of all weights, beside earlier ones."""
    weights.drop("round").write.mode("overwrite").parquet(f"{path}/round={round_}")


def load_checkpoint(spark: SparkSession, path: str, round_: int | None = None) -> DataFrame:
    """A round's weights, the last one's if none is named."""
    rows = spark.read.option("basePath", path).parquet(path)
    if round_ is None:
        round_ = rows.agg(F.max("round")).first()[0]
    return rows.where(F.col("round") == round_)


def to_json(weights: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys and json: {param: [values in coordinate order]}."""
    arrays = weights.groupBy(*keys, "param").agg(F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("_v"))
    arrays = arrays.withColumn("_v", F.transform("_v", lambda x: x["value"]))
    entry = F.array_sort(F.collect_list(F.struct("param", "_v")))
    return arrays.groupBy(*keys).agg(F.to_json(F.map_from_entries(entry)).alias("json"))


def from_json(rows: DataFrame, keys: tuple[str, ...], json: Column | str = "json") -> DataFrame:
    flat = rows.select(*keys, F.explode(F.from_json(json, _JSON)).alias("param", "_v"))
    return flat.select(*keys, "param", F.posexplode("_v").alias("idx", "value"))


def updates_to_json(updates: DataFrame, keys: tuple[str, ...] = ("client", "round")) -> DataFrame:
    """keys and json of updates' descriptions: all further columns but the weights (param, idx, value), null ones left out."""
    rest = [k for k in updates.columns if k not in (*keys, "param", "idx", "value")]
    return updates.select(*keys, *rest).distinct().select(*keys, F.to_json(F.struct(*keys, *rest)).alias("json"))


def updates_from_json(rows: DataFrame, schema: str, json: Column | str = "json") -> DataFrame:
    """Descriptions as columns again, null where one lacks a field."""
    return rows.select(F.from_json(json, schema).alias("_x")).select("_x.*")


def data_sizes(rows: DataFrame, client_col: str) -> DataFrame:
    """(client, n): how many rows each client has."""
    return rows.groupBy(F.col(client_col).alias("client")).agg(F.count("*").alias("n"))


def clients_data(spark: SparkSession, path: str, client_col: str, client) -> DataFrame:
    """One client's rows; the filter reaches the scan."""
    return spark.read.parquet(path).where(F.col(client_col) == client)


def save_run(path: str, round_: int, tables: dict[str, DataFrame]) -> None:
    """Named tables of a run after a round. The round is entered in an index last of all, so a write that broke off is never read."""
    folder = f"{path}/{uuid.uuid4().hex}"
    for name, table in tables.items():
        table.write.parquet(f"{folder}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(round_, folder, time.time(), ",".join(tables))], _INDEX).coalesce(1).write.mode("append").parquet(f"{path}/index")


def load_run(spark: SparkSession, path: str, round_: int | None = None) -> tuple[int, dict[str, DataFrame]]:
    """A round's tables by name, the last round's if none is named, the last write of it if there are several."""
    index = spark.read.schema(_INDEX).parquet(f"{path}/index")
    at = index.where(F.col("round") == round_) if round_ is not None else index
    found = at.orderBy(F.desc("round"), F.desc("at")).first()
    if found is None:
        raise ValueError(f"no checkpoint of round {round_}")
    return found["round"], {name: spark.read.parquet(f"{found['folder']}/{name}") for name in found["tables"].split(",")}


def append_log(rows: DataFrame, path: str) -> None:
    """Add entries of (round, name, value, ...) to a log."""
    rows.write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str, name: str | None = None, rounds: Sequence[int] | None = None) -> DataFrame:
    """Entries of a log, of one metric and of some rounds if these are named (none or an empty list: all rounds); both filters reach the scan."""
    rows = spark.read.parquet(path)
    if name is not None:
        rows = rows.where(F.col("name") == name)
    return rows.where(F.col("round").isin(list(rounds))) if rounds else rows
