"""Tables between the steps of an operator: written to a folder that all executors share, read back, removed."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Rows and bytes of a batch of pages or texts that is handed to Python.
BATCH_ROWS, BATCH_BYTES = 128, 2 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds what one Arrow batch holds; smaller settings stay."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{name}").removesuffix("b")
        if not re.fullmatch("[0-9]+", now) or not 0 < int(now) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; where that is missing (a local session) a temporary folder takes its place."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        top = tempfile.mkdtemp(prefix="tessel-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/tessel-{uuid.uuid4().hex}"


def saved(df: DataFrame, folder: str, name: str) -> DataFrame:
    """df as a table of the folder: its lineage is cut, it survives lost executors, and it is worked out once."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def sampled(df: DataFrame, n: int, most: int, seed, *cols: str) -> DataFrame:
    """df, which has n rows; if these are more than `most`, about so many of them by 63 bits of a hash of the columns."""
    if n <= most:
        return df
    return df.where(F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 1) / F.lit(float(2**63)) < F.lit(most / n))


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """Adds dense row numbers from 0 in the order of the columns `order` (which should leave no ties).

    Rows are sorted over partitions and written; the partitions' sizes are summed up in a table of one row for each, so no
    task numbers the whole table and nothing passes through the driver."""
    folder = shared_dir(df.sparkSession)
    at = F.monotonically_increasing_id()
    ordered = saved(df.sort(*order).withColumns({"__part": F.shiftright(at, 33), "__at": at.bitwiseAND(F.lit((1 << 33) - 1))}), folder, "ordered")
    sizes = ordered.groupBy("__part").agg((F.max("__at") + 1).alias("__n"))
    starts = saved(sizes.select("__part", (F.expr("sum(__n) over (order by __part)") - F.col("__n")).alias("__start")), folder, "starts")
    return ordered.join(starts, "__part").withColumn(name, (F.col("__start") + F.col("__at")).cast("long")).drop("__part", "__at", "__start")


def placed(df: DataFrame, order: list, folder: str, name: str) -> DataFrame:
    """df sorted over partitions in the order of the columns `order` and written, with the partition (part) and the place in it (at)
    of each row: what comes later in the order has the larger (part, at)."""
    here = F.monotonically_increasing_id()
    return saved(df.sort(*order).withColumns({"part": F.shiftright(here, 33), "at": here.bitwiseAND(F.lit((1 << 33) - 1))}), folder, name)


def sums_before(rows: DataFrame, value: str, name: str) -> DataFrame:
    """Adds to rows of placed() the sum of `value` over all rows before each, from a table of one row for each partition."""
    sums = rows.groupBy("part").agg(F.sum(value).alias("__own"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("part", F.coalesce(F.sum("__own").over(earlier), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(starts, "part").withColumn(name, F.col("__start") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("__start")
