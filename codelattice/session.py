"""Session helpers: shared folder lookup, lineage cuts and staged tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# A level of at most so many rows may be broadcast; files of repeating names say too little of their size.
FEW_ROWS = 50_000


def local_session(app: str = "codelattice", cores: str | int = "*") -> SparkSession:
    """A single-machine session for tests and the bench."""
    parallelism = "8" if cores == "*" else str(cores)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", parallelism)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A machine-local folder is chosen only for a local master with the setting
    absent; on a cluster the setting is required.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    active = sc.getCheckpointDir()
    if named:
        if active is None:
            sc.setCheckpointDir(named)
        return named
    if active is not None:
        return active.rsplit("/", 1)[0]
    if sc.master != "local" and not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="codelattice-")
    sc.setCheckpointDir(folder)
    return folder


def stage_root(spark: SparkSession) -> str:
    """Where this application's staged tables live."""
    return f"{shared_dir(spark)}/codelattice-stage/{spark.sparkContext.applicationId}"


def drop_stage(spark: SparkSession) -> None:
    """Delete this application's staged tables; results read from them end with it."""
    sc = spark.sparkContext
    root = sc._jvm.org.apache.hadoop.fs.Path(stage_root(spark))
    root.getFileSystem(sc._jsc.hadoopConfiguration()).delete(root, True)


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint (survives executor loss)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffled(df: DataFrame) -> DataFrame:
    """A side that a join must shuffle, never broadcast.

    The planner takes the size of rows made by an explode, or of repeating text, from compressed
    files: far too small, and a broadcast once planned is not taken back.
    """
    return df.hint("merge")


@contextmanager
def dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """A write in here deletes its shuffle files when it is done, not when the driver happens to collect its garbage.

    The table that it wrote is all that later steps read.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def stage_bucketed(df: DataFrame, name: str, *keys: str) -> tuple[DataFrame, str]:
    """A staged table bucketed and sorted on its keys, for many joins on them.

    Joins read it without another shuffle or sort. Returns the table and its
    catalogue name, to be dropped with ``drop_table`` once the loop is over
    (the files stay in the shared folder).
    """
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"codelattice_{name}_{uuid.uuid4().hex}"
    path = f"{stage_root(spark)}/{table}"
    with dropping_shuffles(spark):
        (
            df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys)
            .option("path", path).format("parquet").saveAsTable(table)
        )
    return spark.table(table), table


def drop_table(spark: SparkSession, table: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {table}")


class Levels:
    """The growing result of a level loop as one staged table.

    Each level is written once and its rows are counted: a small frontier may
    be broadcast by Spark itself, one above ``FEW_ROWS`` is always shuffled.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{stage_root(spark)}/{uuid.uuid4().hex}/{name}"
        self.paths: list[str] = []
        self.schema = None
        self.last_rows = self.rows = 0

    def add(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/level_{len(self.paths)}"
        seen = Observation()
        with dropping_shuffles(self.spark):
            df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("errorifexists").parquet(path)
        self.last_rows = seen.get["rows"]
        self.rows += self.last_rows
        self.schema = df.schema
        self.paths.append(path)
        return self._sized(self.spark.read.schema(self.schema).parquet(path), self.last_rows)

    def all(self) -> DataFrame:
        return self._sized(self.spark.read.schema(self.schema).parquet(*self.paths), self.rows)

    @staticmethod
    def _sized(rows: DataFrame, count: int) -> DataFrame:
        return rows if count <= FEW_ROWS else shuffled(rows)


def stage(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write a derived table to the shared folder and read it back.

    Compared with ``cut`` the result keeps column pruning, filter pushdown,
    partition pruning and file sizes for later joins.
    """
    spark = df.sparkSession
    path = f"{stage_root(spark)}/{uuid.uuid4().hex}/{name}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with dropping_shuffles(spark):
        writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
