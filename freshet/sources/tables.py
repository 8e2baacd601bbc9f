"""Versioned Parquet tables with signed changes, Arrow streams with a __weight column, and the shared folder."""

from __future__ import annotations

import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

W = "__weight"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local folder only where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.getCheckpointDir():
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir is unset: a cluster needs a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="freshet-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, if the session is still there to do so."""
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may have gone before
        pass


def read_version(spark: SparkSession, path: str, version: int) -> DataFrame:
    """The changes of one version (path/v=N) as weighted rows: inserts and new images +1, deletes and old images -1."""
    df = spark.read.parquet(f"{path}/v={version}")
    if "_change_type" not in df.columns:
        return df.withColumn(W, F.lit(1).cast("bigint"))
    gone = F.col("_change_type").isin("delete", "update_preimage")
    return df.withColumn(W, F.when(gone, -1).otherwise(1).cast("bigint")).drop("_change_type")


def write_truncate(df: DataFrame, path: str) -> None:
    """The full view, anew each tick."""
    df.write.mode("overwrite").parquet(path)


def write_changelog(delta: DataFrame, path: str, tick: int) -> None:
    """The tick's signed rows in a folder of their own: a replayed tick overwrites itself, so each counts once."""
    delta.write.mode("overwrite").parquet(f"{path}/tick={tick}")


def to_ipc(delta: DataFrame) -> bytes:
    """An Arrow stream; the weights are the last column."""
    table = delta.select(*[c for c in delta.columns if c != W], W).toArrow()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def from_ipc(spark: SparkSession, data: bytes) -> DataFrame:
    return spark.createDataFrame(pa.ipc.open_stream(data).read_all())
