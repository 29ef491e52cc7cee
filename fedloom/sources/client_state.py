"""State of many clients as a versioned table in hash buckets.

A version names a folder for each bucket. A new version rewrites only the buckets of clients whose state changed and
names the folders of the others again; it is entered in the index last of all, so a write that broke off is never
read. Rows have the column client and whatever else a state needs: a client's rows are replaced together.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

_INDEX = "version bigint, at double, folders array<string>"


class ClientState:
    """The state kept at a path; schema is that of its rows, without the bucket."""

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.dealt = StructType([*self.schema.fields, StructField("bucket", IntegerType())])

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("client"), F.lit(self.buckets)).cast("int")

    def _folders(self, version: int | None) -> tuple[int | None, list[str]]:
        """The version and its folders by bucket ("" for one without rows); of several writes of a version the last."""
        index = f"{self.path}/index"
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(index)
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return None, [""] * self.buckets
        rows = self.spark.read.schema(_INDEX).parquet(index)
        if version is not None:
            rows = rows.where(F.col("version") == version)
        found = rows.orderBy(F.desc("version"), F.desc("at")).first()
        if found is None:
            if version is not None:
                raise ValueError(f"no version {version}")
            return None, [""] * self.buckets
        if len(found["folders"]) != self.buckets:
            raise ValueError(f"kept in {len(found['folders'])} buckets")
        return found["version"], found["folders"]

    def _read(self, folders: list[str]) -> DataFrame:
        paths = sorted({f for f in folders if f})
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, the last one's if none is named; no rows before the first."""
        return self._read(self._folders(version)[1])

    def client(self, client, version: int | None = None) -> DataFrame:
        """One client's rows: a single bucket is read, and the filter reaches its scan."""
        kind = self.schema["client"].dataType
        of = self.spark.range(1).select(F.pmod(F.xxhash64(F.lit(client).cast(kind)), F.lit(self.buckets)).cast("int").alias("b")).first()["b"]
        return self._read([self._folders(version)[1][of]]).where(F.col("client") == F.lit(client).cast(kind))

    def write(self, rows: DataFrame, version: int, based_on: int | None = None) -> list[int]:
        """Replace the rows of all clients in `rows`, and give the buckets that were rewritten.

        based_on: the version that the others' rows come from, the last one if none is named.
        """
        folders = list(self._folders(based_on)[1])
        rows = rows.select(*self.schema.names).withColumn("bucket", self._bucket())
        folder = f"{self.path}/{uuid.uuid4().hex}"
        # as it comes first, so that what follows doesn't compute the rows again
        rows.write.partitionBy("bucket").parquet(f"{folder}/new")
        new = self.spark.read.schema(self.dealt).parquet(f"{folder}/new")
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # no more than there are buckets
        before = self._read([folders[b] for b in touched]).withColumn("bucket", self._bucket())
        others = before.join(new.select("client").distinct(), "client", "left_anti").select(*self.schema.names, "bucket")
        new.select(*self.schema.names, "bucket").unionByName(others).write.partitionBy("bucket").parquet(f"{folder}/state")
        for b in touched:
            folders[b] = f"{folder}/state/bucket={b}"
        entry = self.spark.createDataFrame([(version, time.time(), folders)], _INDEX)
        entry.coalesce(1).write.mode("append").parquet(f"{self.path}/index")
        return sorted(touched)
