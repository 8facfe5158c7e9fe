"""Items dealt out to lanes by size, so that the heaviest lane has little more than it must."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessel.tables import placed, saved, shared_dir, sums_before


def balanced(items: DataFrame, lanes: int, key: str = "id", size: str = "size") -> DataFrame:
    """Adds lane (0 to lanes - 1) to items; the heaviest lane has at most 4/3 of what the best division would give it.

    Items above a third of the mean lane, of which there are fewer than three a lane, are placed longest first, each in the lane
    that has least. The others fill the lanes up to a common level: they are sorted over partitions, and a place in the sums
    before them names the lane, so an item goes over the level by its own size at most. Null and negative sizes count as 0; ties
    go by key; an empty table gives an empty one. Columns of items stay, but for one called lane."""
    if lanes < 1:
        raise ValueError("lanes")
    spark, folder = items.sparkSession, shared_dir(items.sparkSession)
    items = items.drop("lane")
    # the columns of items travel as one, so that none can clash with those that are made here
    own = items.select(F.struct(*[F.col(f"`{c}`") for c in items.columns]).alias("__row"), F.col(key).alias("__key"), F.greatest(F.coalesce(F.col(size).cast("double"), F.lit(0.0)), F.lit(0.0)).alias("__size"))
    total = own.agg(F.sum("__size")).first()[0] or 0.0
    large = F.col("__size") > total / lanes / 3
    load = [(0.0, k) for k in range(lanes)]
    put = []
    named = own.withColumn("__name", F.struct(F.col("__key").isNull().alias("none"), F.coalesce(F.col("__key").cast("string"), F.lit("")).alias("name")))
    for r in named.where(large).orderBy(F.desc("__size"), "__key").select("__name", "__size").collect():  # fewer than 3 * lanes
        have, lane = heapq.heappop(load)
        put.append((tuple(r["__name"]), r["__size"], lane))
        heapq.heappush(load, (have + r["__size"], lane))
    # the level that the rest fills the lanes up to, and where each lane's share of the rest begins
    rest, level, filled = total - sum(h for h, _ in load), 0.0, sorted(load)
    for k in range(lanes):
        level = (rest + sum(h for h, _ in filled[: k + 1])) / (k + 1)
        if k + 1 == lanes or level <= filled[k + 1][0]:
            break
    room, ends = 0.0, []
    for have, lane in filled:
        if have < level or not ends:
            room += max(level - have, 0.0)
            ends.append((room, lane))
    bounds, of = F.array(*[F.lit(e) for e, _ in ends]), F.array(*[F.lit(lane) for _, lane in ends])
    rows = sums_before(placed(own.where(~large), [F.desc("__size"), F.col("__key")], folder, "rest"), "__size", "__before")
    at = F.least(F.size(F.filter(bounds, lambda e: e <= F.col("__before"))), F.lit(len(ends) - 1))
    small = rows.select("__row.*", F.element_at(of, at + 1).alias("lane"))
    if not put:
        return small
    known = spark.createDataFrame(put, "__name struct<none: boolean, name: string>, __size double, lane int")
    known = known.groupBy("__name", "__size").agg(F.array_sort(F.collect_list("lane")).alias("__lanes"))
    place = F.row_number().over(Window.partitionBy("__name", "__size").orderBy(F.lit(1)))
    big = named.where(large).withColumn("__k", place).join(F.broadcast(known), ["__name", "__size"]).withColumn("lane", F.element_at("__lanes", F.col("__k")))
    return saved(small.unionByName(big.select("__row.*", "lane")), folder, "lanes")


def loads(dealt: DataFrame, lanes: int, size: str = "size") -> DataFrame:
    """(lane, n, size) of every lane, empty ones included."""
    sums = dealt.groupBy("lane").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("size"))
    every = dealt.sparkSession.range(lanes).select(F.col("id").cast("int").alias("lane"))
    return every.join(sums, "lane", "left").select("lane", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("size", F.lit(0)).alias("size"))
