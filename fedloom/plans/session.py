"""Session set-up, shipping of the package to executors, and work tables that outlive executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE_ROOT = Path(__file__).resolve().parents[1]
_LOCAL_DIRS: dict[str, str] = {}
_SHIPPED: set[str] = set()


def build_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "fedloom") -> SparkSession:
    """A local session with the settings that the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Give executors this package, once for each application: they need no installed copy."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    folder = Path(tempfile.mkdtemp(prefix="fedloom-ship-"))
    target = folder / "fedloom_pkg.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(PACKAGE_ROOT.rglob("*.py")):
            z.write(path, f"{PACKAGE_ROOT.name}/{path.relative_to(PACKAGE_ROOT).as_posix()}")
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, or, only where that is unset, a temporary one for local runs."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = "file://" + tempfile.mkdtemp(prefix="fedloom-work-")
    return _LOCAL_DIRS[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def work_table(spark: SparkSession, df: DataFrame, name: str, *partition_by: str, codec: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends there, and a lost executor costs no recomputation."""
    return _written(spark, df, new_path(spark, name), partition_by, codec)


def _written(spark: SparkSession, df: DataFrame, path: str, partition_by: tuple[str, ...], codec: str, row_group: int | None = None) -> DataFrame:
    writer = df.write.option("compression", codec)
    if row_group:
        # by itself the writer looks at its size only after each hundredth row
        writer = writer.option("parquet.block.size", row_group).option("parquet.page.size.row.check.min", 1)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within it, what runs hands at most so many rows at once to Python, so that long values need less memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Scratch:
    """Work tables of one run, which can be deleted once what was made of them is written itself."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.held: list[tuple[DataFrame, str]] = []

    def table(self, df: DataFrame, name: str, *partition_by: str, codec: str = "zstd", row_group: int | None = None) -> DataFrame:
        """row_group: for rows of megabytes, how many bytes of them the writer, and later a reader, holds at once."""
        path = new_path(self.spark, name)
        out = _written(self.spark, df, path, partition_by, codec, row_group)
        self.held.append((out, path))
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete these tables; a table that isn't of this run is left alone."""
        gone = [x for x in self.held if any(x[0] is t for t in tables)]
        self.held = [x for x in self.held if not any(x is y for y in gone)]
        hadoop = self.spark.sparkContext._jsc.hadoopConfiguration()
        for _, path in gone:
            at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(hadoop).delete(at, True)

    def drop_but(self, *tables: DataFrame) -> None:
        self.drop(*[t for t, _ in self.held if not any(t is k for k in tables)])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table by name, through Spark's reader only."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
