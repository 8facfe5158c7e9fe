"""Merging of profiles and envelopes: appending with fresh ids, imported names, cascades of deletes, table columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def append_fresh(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """old and all of new; an id that old has already is replaced by one from the row's hash, so that reruns agree."""
    taken = old.select(F.col(key), F.lit(True).alias("__taken")).distinct()
    row = F.sha1(F.to_json(F.struct(*sorted(new.columns)), {"ignoreNullFields": "false"}))
    out = new.join(taken, key, "left").withColumn(key, F.when(F.col("__taken"), F.substring(row, 1, 12)).otherwise(F.col(key))).drop("__taken")
    return old.unionByName(out.select(*old.columns))


def imported(old: DataFrame, new: DataFrame, name: str = "name", mark: str = " (imported)") -> DataFrame:
    """new with marked names where old has the name, and numbers where it has the marked one as well."""
    has = old.select(F.col(name), F.lit(True).alias("__has")).distinct()
    marked = has.select(F.col(name).alias("__m"), F.col("__has").alias("__has_m"))
    out = new.join(has, name, "left").join(marked, F.concat(new[name], F.lit(mark)) == F.col("__m"), "left").drop("__m")
    k = F.row_number().over(Window.partitionBy(name).orderBy("pos"))
    extra = F.when(F.col("__has_m") | (F.col("__k") > 1), F.concat(F.lit(" "), (F.col("__k") + F.coalesce(F.col("__has_m").cast("int"), F.lit(0))).cast("string"))).otherwise("")
    return out.withColumn("__k", k).withColumn(name, F.when(F.col("__has"), F.concat(F.col(name), F.lit(mark), extra)).otherwise(F.col(name))).drop("__has", "__has_m", "__k")


def envelope(chats: DataFrame) -> DataFrame:
    """(chat, json): chats as they are given away: without their group, and not private."""
    kept = [c for c in chats.columns if c not in ("group_id", "private")]
    return chats.select("chat", F.to_json(F.struct(*kept, F.lit(False).alias("private"))).alias("json"))


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows of new in place of those of old with their id."""
    return old.join(new.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def delete_group(groups: DataFrame, chats: DataFrame, group: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(groups, chats, ids of the chats that go with the group)."""
    gone = F.coalesce(F.col("group_id") == group, F.lit(False))
    return groups.where(F.col("id") != group), chats.where(~gone), chats.where(gone).select("chat")


def columns(df: DataFrame, key: tuple[str, ...] = ()) -> list[tuple[str, str, bool, bool]]:
    """(name, type, part of the key, nullable) of a table's columns."""
    return [(f.name, f.dataType.simpleString(), f.name in key, f.nullable) for f in df.schema]
