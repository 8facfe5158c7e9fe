"""What a folder of Parquet files should hold, file by file, so that damage is found and never written over."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessel.tables import discard

#: Spark's readers pass over names that begin so; the manifest lies in the folder that it is about.
NAME = "_manifest"


class DamagedStore(Exception):
    """A folder holds not what was recorded; the message says which files and what to do."""


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _short(column, path: str):
    """The name of a file below the folder: what follows the folder's own last name, so a folder can be moved under another."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return F.element_at(F.split(column, f"/\\Q{name}\\E/"), -1)


def _contents(files: DataFrame, path: str) -> DataFrame:
    """(file, rows, sum): the sum does not depend on the order of rows, and repeated rows do not cancel out."""
    one = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in files.columns]), {"ignoreNullFields": "false"})).cast("decimal(38,0)")
    own = files.select(_short(F.col("_metadata.file_path"), path).alias("file"), one.alias("h"))
    return own.groupBy("file").agg(F.count("*").alias("rows"), F.sum("h").alias("sum"))


def _lengths(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes) of the Parquet files that are there; their contents are not read."""
    there = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)
    return there.select(_short(F.col("path"), path).alias("file"), F.col("length").alias("bytes"))


def record(spark: SparkSession, path: str) -> DataFrame:
    """Writes down the rows, checksum and bytes of every file of the folder, and its schema; reads it back."""
    files = spark.read.parquet(path)
    found = _contents(files, path).join(_lengths(spark, path), "file", "full_outer")
    found.select("file", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("sum", F.lit(0)).cast("decimal(38,0)").alias("sum"), "bytes", F.lit(files.schema.json()).alias("schema")).write.mode("overwrite").parquet(f"{path}/{NAME}")
    return recorded(spark, path)


def recorded(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{NAME}")


def check(spark: SparkSession, path: str) -> DataFrame:
    """(file, rows, found, state) of every file that was recorded or is there.

    state is ok; missing; damaged, if it cannot be read to its end or holds other rows or bytes than recorded; or new, if it was never
    recorded. `rows` are those recorded (0 for new files), `found` those that could be read. Files that are damaged do not end the
    job: Spark reads what it can of them, and the counts tell."""
    want = recorded(spark, path)
    first = want.select("schema").first()
    there = _lengths(spark, path)
    if first:
        files = spark.read.schema(StructType.fromJson(json.loads(first.schema))).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).parquet(path)
        there = there.join(_contents(files, path), "file", "left")
    else:
        there = there.withColumns({"rows": F.lit(0).cast("long"), "sum": F.lit(0).cast("decimal(38,0)")})
    there = there.select("file", F.col("bytes").alias("__bytes"), F.coalesce("rows", F.lit(0)).alias("found"), F.coalesce("sum", F.lit(0)).cast("decimal(38,0)").alias("__sum"))
    both = want.join(there, "file", "full_outer")
    same = (F.col("rows") == F.col("found")) & (F.col("sum") == F.col("__sum")) & F.col("bytes").eqNullSafe(F.col("__bytes"))
    state = F.when(F.col("schema").isNull(), "new").when(F.col("__bytes").isNull(), "missing").when(same, "ok").otherwise("damaged")
    return both.select("file", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("found", F.lit(0)).alias("found"), state.alias("state"))


def opened(spark: SparkSession, path: str) -> DataFrame:
    """The table of the folder, if all that was recorded is there and whole; else DamagedStore."""
    bad = check(spark, path).where("state in ('missing', 'damaged')")
    n = bad.groupBy("state").agg(F.count("*").alias("n"), F.min("file").alias("file")).orderBy("state").collect()
    if n:
        said = "; ".join(f"{r.n} {r.state}, such as {r.file}" for r in n)
        raise DamagedStore(f"{path}: {said}. Nothing was changed: restore these files or compile into another folder.")
    return spark.read.parquet(path)


def written(df: DataFrame, path: str) -> DataFrame:
    """df as the folder's new contents, recorded. A folder that is damaged, or has Parquet files but no manifest, is left as it is and
    DamagedStore is raised. The rows may come from the folder itself: they are written aside first."""
    spark = df.sparkSession
    if _exists(spark, f"{path}/{NAME}"):
        opened(spark, path)
    elif _exists(spark, path) and not _lengths(spark, path).isEmpty():
        raise DamagedStore(f"{path}: files without a manifest. Nothing was changed: record() them if they are right.")
    aside = f"{path.rstrip('/')}-aside"
    df.write.mode("overwrite").parquet(aside)
    record(spark, aside)
    at, new = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, aside))
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    discard(spark, path)
    if not fs.rename(new, at):
        raise OSError(f"{aside} could not be renamed to {path}; it holds the new contents")
    return spark.read.parquet(path)
