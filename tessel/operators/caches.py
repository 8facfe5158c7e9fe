"""What a cache of the last few keys would do over a sequence of accesses: hits, misses and what they evict.

The state of a cache that holds the `capacity` keys used last is short, and states compose: after a stretch of accesses come its own
last keys, then those from before it that it did not touch. So a long sequence is cut into stretches of sorted partitions, each
stretch is summed up by its last keys, the summaries are composed in order, and every stretch is then replayed from its own
beginning."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessel.tables import placed, saved, shared_dir

CAPACITY = 8


def _composed(capacity: int):
    """Summaries (cache, part, keys: latest first) in their order -> (cache, part, held: what the stretch begins with)."""
    none = object()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, held = none, []
        for b in batches:
            out = []
            for own, part, keys in zip(*(c.to_pylist() for c in b.columns)):
                if cache is none or own != cache:
                    cache, held = own, []
                out.append((own, part, held))
                held = [*keys, *(k for k in held if k not in keys)][:capacity]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], b.schema.field(k).type) for k in range(3)], ["cache", "part", "held"])

    return run


def _replayed(capacity: int):
    """Rows (cache, seq, key, held) in their order, each stretch's `held` in a row before its accesses -> (cache, seq, key, hit, evicted)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for b in batches:
            out = []
            for cache, seq, key, start in zip(*(c.to_pylist() for c in b.columns)):
                if start is not None:
                    held = dict.fromkeys(reversed(start))
                    continue
                hit, evicted = key in held, None
                held.pop(key, None)
                held[key] = None
                if len(held) > capacity:
                    evicted = next(iter(held))
                    del held[evicted]
                out.append((cache, seq, key, hit, evicted))
            kinds = [b.schema.field(0).type, b.schema.field(1).type, b.schema.field(2).type, pa.bool_(), b.schema.field(2).type]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)], ["cache", "seq", "key", "hit", "evicted"])

    return run


def replay(accesses: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(cache, seq, key, hit, evicted) of accesses (cache, seq, key): whether the key is among the `capacity` distinct keys that the
    cache used last, and which key goes for it otherwise.

    Accesses of a cache follow each other by seq (ties by key). One cache may have any share of all accesses. Null keys and null
    caches are a key and a cache like others. Other columns are not read; an empty table gives an empty one."""
    folder = shared_dir(accesses.sparkSession)
    rows = placed(accesses.select("cache", "seq", "key"), ["cache", "seq", "key"], folder, "accesses")
    last = rows.groupBy("cache", "part", "key").agg(F.max("at").alias("at"))
    latest = F.row_number().over(Window.partitionBy("cache", "part").orderBy(F.desc("at")))
    kept = last.withColumn("place", latest).where(F.col("place") <= capacity)
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("cache", "seq", "key")}
    ends = kept.groupBy("cache", "part").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "key"))), lambda x: x["key"]).alias("keys"))
    starts = ends.repartition("cache").sortWithinPartitions("cache", "part").mapInArrow(_composed(capacity), f"cache {kinds['cache']}, part long, held array<{kinds['key']}>")
    head = starts.select("cache", F.lit(None).cast(kinds["seq"]).alias("seq"), F.lit(None).cast(kinds["key"]).alias("key"), "part", F.lit(-1).cast("long").alias("at"), "held")
    all_ = rows.withColumn("held", F.lit(None).cast(f"array<{kinds['key']}>")).unionByName(head)
    # a stretch is the rows of a cache in a sorted partition; its head comes first
    lined = all_.repartition("part").sortWithinPartitions("part", "cache", "at").select("cache", "seq", "key", "held")
    return saved(lined.mapInArrow(_replayed(capacity), f"cache {kinds['cache']}, seq {kinds['seq']}, key {kinds['key']}, hit boolean, evicted {kinds['key']}"), folder, "replayed")
