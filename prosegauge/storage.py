"""Intermediate tables in the folder that all executors share, and batches to Python workers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Bytes of a batch that goes to a Python worker, and of a row group that a task gathers before it writes it.  A task that
#: reads a row group holds all of it.
SLICE_BYTES, GROUP_BYTES = 2 << 20, 8 << 20

#: What a task holds at once is bounded in bytes, or in so few rows that long texts fit: batches to Python, row groups,
#: rows of a batch of Parquet; and row groups are not read by ranges, which are all allotted at once.
BOUNDS = {
    "spark.sql.execution.arrow.maxBytesPerBatch": SLICE_BYTES, "parquet.block.size": GROUP_BYTES,
    "spark.sql.parquet.columnarReaderBatchSize": 256, "parquet.hadoop.vectored.io.enabled": "false",
}


def bounded(spark: SparkSession) -> None:
    """From now on the session's tasks hold only so much of texts at once, whatever their number."""
    for key, value in BOUNDS.items():
        spark.conf.set(key, str(value))


def small_batches(df: DataFrame) -> DataFrame:
    """Batches of texts are bounded in bytes, not only in rows: ten thousand long texts are too much at once."""
    bounded(df.sparkSession)
    return df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a new local one only where that is unset and all runs on
    this machine (tests)."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = tempfile.mkdtemp(prefix="prosegauge-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark)}/prosegauge/{spark.sparkContext.applicationId}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later jobs neither recompute it nor depend on one executor."""
    bounded(df.sparkSession)
    path = f"{own_dir(df.sparkSession)}/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete the application's intermediate tables.  Results that have not been written yet can no longer be read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
