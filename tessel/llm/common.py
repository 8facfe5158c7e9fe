"""What the operators of this subpackage share: reading documents, Arrow batches, tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of a batch handed to Python. Small, as one document may hold megabytes.
BATCH_ROWS, BATCH_BYTES = 256, 4 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds what one Arrow batch holds, so that a Python worker's memory does not follow the documents' lengths."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def large_batches(spark: SparkSession) -> None:
    """For narrow rows, such as hashes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which all executors and the driver see.

    Where the setting is missing (a local session, as in tests) a temporary folder takes its place.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        top = tempfile.mkdtemp(prefix="tessel-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/tessel-{uuid.uuid4().hex}"


def saved(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Writes df as a table of the shared folder and reads it back: this cuts the lineage and survives lost executors."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Removes a table of the shared folder that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def draw(seed: str, *cols: str) -> Column:
    """A number from 0 to 1 (63 bits of a hash of the columns), the same on every run."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 1) / F.lit(float(2**63))


def sampled(df: DataFrame, n: int, most: int, seed: str, *cols: str) -> DataFrame:
    """df, which has n rows; if these are more than `most`, about so many of them by a hash of the columns, at any n."""
    return df if n <= most else df.where(draw(seed, *cols) < F.lit(most / n))


def unused(name: str, *frames: DataFrame) -> str:
    """A column name that no frame has, whatever the case of its letters."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme and authority of the store that Spark writes it to."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
