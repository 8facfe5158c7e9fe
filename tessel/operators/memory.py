"""Memory profiles: entries (core, id, category, text, importance, pinned, origin, created) and operations on them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessel.tables import saved, shared_dir

#: Fixed values.
CATEGORIES = ("preferences", "facts", "interests", "style", "goals", "other")
#: Operations that are folded at a time, about.
FOLDED = 2000
ENTRY = "core string, id string, category string, text string, importance int, pinned boolean, origin string, created string"


def normalise(entries: DataFrame) -> DataFrame:
    """Importance from 1 to 10 (5 if missing), known categories, no blank texts."""
    imp = F.coalesce(F.col("importance").cast("string").try_cast("double").cast("int"), F.lit(5))
    cat = F.lower(F.trim(F.coalesce("category", F.lit(""))))
    out = entries.withColumns({"importance": F.greatest(F.lit(1), F.least(F.lit(10), imp)), "category": F.when(cat.isin(*CATEGORIES), cat).otherwise("other"), "text": F.trim("text")})
    return out.where(F.coalesce(F.col("text"), F.lit("")) != "")


def injected(entries: DataFrame, limit: int) -> DataFrame:
    """Entries that go into a prompt: all pinned ones and the `limit` most important others of each core."""
    k = F.row_number().over(Window.partitionBy("core", "pinned").orderBy(F.desc("importance"), "created", "id"))
    return entries.withColumn("__k", k).where(F.col("pinned") | (F.col("__k") <= limit)).drop("__k")


def needs_consolidation(n: F.Column, limit: F.Column, last: F.Column) -> F.Column:
    return (n > limit * 1.5) & (n > F.coalesce(last, F.lit(0)))


def _protected(e: dict) -> bool:
    return bool(e["pinned"]) or e["origin"] == "user"


def _threads(operations: DataFrame) -> DataFrame:
    """(core, id, thread): ids that merges join, directly or over others, with the smallest of them.

    Each round every id takes the smallest thread of its merges, and that one's own; chains halve, so rounds are few."""
    folder = shared_dir(operations.sparkSession)
    merges = operations.where("op = 'merge'").select("core", "seq", F.explode(F.array_distinct(F.coalesce("ids", F.array().cast("array<string>")))).alias("id"))
    edges = saved(merges, folder, "edges")
    threads, turn = saved(edges.select("core", "id").distinct().withColumn("thread", F.col("id")), folder, "threads0"), 0
    while True:
        turn += 1
        least = edges.join(threads, ["core", "id"]).groupBy("core", "seq").agg(F.min("thread").alias("thread"))
        near = edges.join(least, ["core", "seq"]).groupBy("core", "id").agg(F.min("thread").alias("near"))
        jump = near.select("core", F.col("id").alias("near"), F.col("near").alias("thread"))
        now = saved(near.join(jump, ["core", "near"], "left").select("core", "id", F.least("near", F.coalesce("thread", "near")).alias("thread")), folder, f"threads{turn}")
        if now.join(threads, ["core", "id", "thread"], "left_anti").isEmpty():
            return now
        threads = now


def apply_operations(entries: DataFrame, operations: DataFrame) -> DataFrame:
    """Entries after the operations (core, seq, op, id, ids, text, category, importance) of each core, in order of seq.

    add appends; update changes any entry; delete leaves pinned and user entries alone; merge needs two or more distinct
    unprotected ones, keeps the first with the new text and the highest importance, and drops the others.

    An operation sees what those before it left of its own entries, and only merges join entries. So entries that no
    operation names pass untouched, and the others are folded by thread: an entry with its updates and deletes, or those that
    merges join. A core with very many entries is spread over tasks.
    """
    columns = [c.split()[0] for c in ENTRY.split(", ")]
    named = operations.withColumn("id", F.when(F.col("op") == "add", F.concat_ws("-", "core", "seq")).otherwise(F.col("id")))
    threads = _threads(named)
    own = lambda df: df.join(threads, ["core", "id"], "left").withColumn("thread", F.coalesce("thread", "id"))
    single = own(named.where("op <> 'merge' and id is not null"))
    merged = named.where("op = 'merge' and size(ids) > 0").withColumn("__id", F.col("id")).withColumn("id", F.get("ids", F.lit(0)))
    ops = single.unionByName(own(merged).withColumn("id", F.col("__id")).drop("__id"))
    marked = own(entries.select(*columns))
    touched = ops.select("core", "thread").distinct()
    left = marked.join(touched, ["core", "thread"], "left_anti").select(*columns)

    def fold(own: pd.DataFrame, ops: pd.DataFrame) -> pd.DataFrame:
        """Some threads at once: they do not touch each other, so one pass in order of seq does for all."""
        left = {(r["core"], r["id"]): r for r in own.sort_values(["created", "id"]).to_dict("records")}
        clamp = lambda x, default: default if x is None or pd.isna(x) else max(1, min(10, int(x)))
        category = lambda x: y if (y := (x or "").strip().lower()) in CATEGORIES else "other"
        for o in ops.sort_values("seq").to_dict("records"):
            core, text = o["__core"], (o["text"] or "").strip()
            at = core, o["id"]
            e = left.get(at)
            if o["op"] == "add" and text:
                left[at] = {"core": core, "id": o["id"], "category": category(o["category"]), "text": text, "importance": clamp(o["importance"], 5), "pinned": False, "origin": "ai", "created": "~"}
            elif o["op"] == "update" and e and text:
                e |= {"text": text, "importance": clamp(o["importance"], e["importance"]), "category": category(o["category"]) if o["category"] else e["category"]}
            elif o["op"] == "delete" and e and not _protected(e):
                del left[at]
            elif o["op"] == "merge" and text and o["ids"] is not None:
                ids = [(core, i) for i in dict.fromkeys(o["ids"]) if (core, i) in left and not _protected(left[core, i])]
                if len(ids) >= 2:
                    first = left[ids[0]]
                    first |= {"text": text, "category": category(o["category"] or first["category"]), "importance": clamp(o["importance"], max(left[i]["importance"] for i in ids))}
                    for i in ids[1:]:
                        del left[i]
        return pd.DataFrame([{c: e[c] for c in columns} for e in left.values()], columns=columns)

    # other names: both tables may come from the same one; threads are folded about FOLDED operations at a time
    named_ops = ops.withColumnsRenamed({"core": "__core", "thread": "__thread"})
    parts = F.lit(operations.count() // FOLDED + 1)
    part = lambda *cols: F.pmod(F.xxhash64(*cols), parts)
    entries_of = marked.join(touched, ["core", "thread"], "left_semi").withColumn("__part", part("core", "thread"))
    folded = entries_of.groupBy("__part").cogroup(named_ops.withColumn("__ops", part("__core", "__thread")).groupBy("__ops")).applyInPandas(fold, ENTRY)
    return left.unionByName(folded)


def operation_summary(operations: DataFrame) -> DataFrame:
    return operations.groupBy("op").agg(F.count("*").alias("n"))
