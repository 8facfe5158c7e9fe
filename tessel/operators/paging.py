"""Continuation pages put in order: threads that a task can hold are walked there, longer ones are ranked by pointer doubling."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessel.tables import discard, saved, shared_dir

#: Pages that one window sums up, and that a task walks.
BLOCK = 4096


def walked(pages: DataFrame, starts: DataFrame) -> DataFrame:
    """(thread, token, rank) of the pages that a walk from each thread's first token reaches, rank 0 first.

    pages: (thread, token, next), starts: (thread, token). The walk ends where next is null or names no page, and at the first
    token that it has seen before. A token has one page (the smallest next of several, null last); threads without their first
    page have no rows. Null threads and tokens are left out. Threads of up to 2 BLOCK rows, of pages and starts, are gathered
    and walked in a task; the pages of longer ones are ranked by doubled()."""
    folder = shared_dir(pages.sparkSession)
    # a row for each page and start
    mark = lambda df, next_, start: df.where("thread is not null and token is not null").select("thread", "token", next_.alias("next"), F.lit(start).alias("start"))
    none = F.lit(None).cast(pages.schema["next"].dataType)
    rows = mark(pages, F.col("next"), False).unionByName(mark(starts, none, True))
    sizes = rows.groupBy("thread").agg(F.count("*").alias("n")).where(F.col("n") > 2 * BLOCK).select("thread")
    long_ = saved(sizes, folder, "long")
    if long_.isEmpty():
        return _gathered(rows)
    rest = lambda df: df.join(long_, "thread", "left_semi")
    return _gathered(rows.join(long_, "thread", "left_anti")).unionByName(doubled(rest(pages), rest(starts)))


def _gathered(rows: DataFrame) -> DataFrame:
    """(thread, token, rank) by a walk over the rows (thread, token, next, start) of each thread, which one task holds."""
    own = rows.groupBy("thread").agg(F.collect_list(F.struct("token", "next", "start")).alias("rows"))
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("thread", "token")) + ", rank long"

    def walk(batches):
        for b in batches:
            at, tokens, ranks = [], [], []
            for k, pages in enumerate(b.column(1).to_pylist()):
                following, here = {}, set()
                for r in pages:
                    if r["start"]:
                        here.add(r["token"])
                    elif (old := following.get(r["token"])) is None or r["next"] is not None and r["next"] < old:
                        following[r["token"]] = r["next"]
                found, here, rank = {}, here & following.keys(), 0
                while here:  # several starts walk side by side
                    found |= dict.fromkeys(here, rank)
                    here, rank = {n for t in here if (n := following[t]) in following} - found.keys(), rank + 1
                at += [k] * len(found)
                tokens += found
                ranks += found.values()
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(tokens, b.column(1).type.value_type.field("token").type), pa.array(ranks, pa.int64())], names=["thread", "token", "rank"])

    return own.mapInArrow(walk, kinds)


def doubled(pages: DataFrame, starts: DataFrame) -> DataFrame:
    """walked() for threads of any length. Each round doubles the distance: who is reached within 2^k steps is joined with the pages
    that are 2^k steps on, and of several ways to a page the first counts."""
    folder, turn = shared_dir(pages.sparkSession), 0
    once = pages.where("thread is not null and token is not null").groupBy("thread", "token").agg(F.min("next").alias("next"))
    jump = saved(once, folder, "jump0")
    seen = saved(jump.select("thread", "token").join(starts.select("thread", "token").distinct(), ["thread", "token"], "left_semi").withColumn("rank", F.lit(0).cast("long")), folder, "seen0")
    size, before = seen.count(), -1
    while size > before:
        known = jump.select("thread", F.col("token").alias("next"), F.col("next").alias("far"))
        ahead = seen.join(jump, ["thread", "token"]).select("thread", F.col("next").alias("token"), (F.col("rank") + F.lit(2**turn)).alias("rank"))
        reached = ahead.join(once.select("thread", "token"), ["thread", "token"], "left_semi")
        wider = saved(seen.unionByName(reached).groupBy("thread", "token").agg(F.min("rank").alias("rank")), folder, f"seen{turn + 1}")
        farther = saved(jump.join(known, ["thread", "next"]).select("thread", "token", F.col("far").alias("next")).where("next is not null"), folder, f"jump{turn + 1}")
        before, size = size, wider.count()
        for old in (f"seen{turn}", f"jump{turn}"):
            discard(pages.sparkSession, f"{folder}/{old}")
        seen, jump, turn = wider, farther, turn + 1
    return seen


def collected(pages: DataFrame, starts: DataFrame, target: int) -> DataFrame:
    """(thread, token, rank, place, comment): the comments of the pages (thread, token, next, comments: array) in the order of the walk
    from `starts`, the first `target` of each thread. Pages after the one that reaches the target are not opened."""
    sized = walked(pages, starts).join(pages.select("thread", "token", "next", "comments"), ["thread", "token"])
    sized = sized.withColumn("n", F.coalesce(F.greatest(F.size("comments"), F.lit(0)), F.lit(0)))
    blocks = sized.groupBy("thread", F.floor(F.col("rank") / BLOCK).alias("block")).agg(F.sum("n").alias("own"))
    earlier = Window.partitionBy("thread").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts_ = blocks.select("thread", "block", F.coalesce(F.sum("own").over(earlier), F.lit(0)).alias("start")).where(F.col("start") < target)
    inside = Window.partitionBy("thread", "block").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    counted = sized.withColumn("block", F.floor(F.col("rank") / BLOCK)).join(starts_, ["thread", "block"])
    counted = counted.withColumn("first", F.col("start") + F.coalesce(F.sum("n").over(inside), F.lit(0))).where(F.col("first") < target)
    rows = counted.select("thread", "token", "rank", "first", F.posexplode("comments").alias("k", "comment"))
    return rows.select("thread", "token", "rank", (F.col("first") + F.col("k")).alias("place"), "comment").where(F.col("place") < target)
