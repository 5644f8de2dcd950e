"""Tables that iterations write between their rounds, in the shared folder that the cluster names, and sizes of tasks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Rows that one task takes of a table whose size is known.
ROWS = 1_000_000


def tasks(spark: SparkSession, rows: int) -> int:
    """Partitions for so many rows: they grow with the table, so a task doesn't, and no core is idle. Spark's own number is
    fixed, and it joins partitions by their compressed bytes."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where that is unset (tests, one machine), a temporary one."""
    sc = spark.sparkContext
    if at := sc.getConf().get("spark.checkpoint.dir"):
        return at.rstrip("/")
    if (now := sc._jsc.sc().getCheckpointDir()).isDefined():
        return now.get().rstrip("/")
    sc.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='tessera-')}")
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's JVM ends."""
    at = f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return at


def drop(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def saved(df: DataFrame, name: str, **options: object) -> DataFrame:
    """The table, written to the shared folder and read again: later plans start there, also after an executor is lost.
    options: of the Parquet writer."""
    spark = df.sparkSession
    at = scratch(spark, name)
    df.write.options(**options).parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out.scratch_path = at
    return out
