"""Several ways to get one thing, tried from the best down, for each half of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Titles of playlist entries that are no longer there.
DEAD_TITLES = ("[deleted video]", "[private video]")


def best_attempts(attempts: DataFrame, stored: int = 0) -> DataFrame:
    """(id, half, rung, value, failed, write) of attempts (id, half, rung, ok, value): for each half of a thing (its transcript, its comments)
    the value of the lowest rung that gave one; each half falls through on its own.

    Rung `stored` is the cache; a value from another rung is to be written back. `failed` counts the rungs below that one which gave nothing, or all
    where none did: rung and value are null then, and nothing is written. A blank value is none; of several values of a rung the least
    counts. One aggregation, combined before the shuffle."""
    good = F.coalesce(F.col("ok"), F.lit(False)) & (F.trim(F.coalesce("value", F.lit(""))) != "")
    rungs = attempts.groupBy("id", "half", "rung").agg(F.min(F.when(good, F.col("value"))).alias("value"))
    best = F.min(F.when(F.col("value").isNotNull(), F.struct("rung", "value")))
    bad = F.array_compact(F.collect_list(F.when(F.col("value").isNull(), F.col("rung"))))
    own = rungs.groupBy("id", "half").agg(best.alias("b"), bad.alias("bad"))
    failed = F.size(F.filter("bad", lambda r: F.col("b").isNull() | (r < F.col("b.rung"))))
    return own.select("id", "half", "b.rung", "b.value", failed.cast("long").alias("failed"), F.coalesce(F.col("b.rung") != stored, F.lit(False)).alias("write"))


def live_entries(entries: DataFrame) -> DataFrame:
    """Entries (playlist, pos, id, title) that are still there, by their place among these from 1; without an id, or with a title that says so, an entry is dead."""
    title = F.lower(F.trim(F.coalesce("title", F.lit(""))))
    live = entries.where((F.coalesce("id", F.lit("")) != "") & ~title.isin(*DEAD_TITLES))
    return live.withColumn("place", F.row_number().over(Window.partitionBy("playlist").orderBy("pos", "id")))
