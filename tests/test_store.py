import re

import pytest
from pyspark.sql import functions as F

from tessel.operators import index
from tessel.streaming.sync import sync_messages


def embed(missing):
    return missing.select("embed_hash", F.array(F.length("content").cast("double")).alias("embedding"))


def chunks_of(spark, texts):
    items = spark.createDataFrame([("t", "s", str(k), t, "{}") for k, t in enumerate(texts)], "source_type string, source_id string, item_id string, content string, meta string")
    return index.chunk_items(items)


def test_stored_vectors_are_not_shuffled(spark, tmp_path):
    """What the store lends is filtered by the chunks' hashes before anything moves; a vector is lent once for all its rows."""
    made = index.with_vectors(chunks_of(spark, ["one text", "two texts", "one text"]), chunks_of(spark, []).withColumn("embedding", F.lit(None).cast("array<double>")).withColumn("model", F.lit("m")), embed, "m")
    made.drop("reused").write.parquet(str(tmp_path / "stored"))
    stored = spark.read.parquet(str(tmp_path / "stored"))
    again = index.with_vectors(chunks_of(spark, ["two texts", "three texts are here"]), stored, embed, "m")
    assert sorted((r.content, r.reused, r.embedding) for r in again.collect()) == [("three texts are here", False, [20.0]), ("two texts", True, [9.0])]
    assert "stored" not in again._jdf.queryExecution().optimizedPlan().toString().replace("restored", "")
    wanted = spark.createDataFrame([("h",)], "embed_hash string")
    plan = index.cached_vectors(stored.join(F.broadcast(wanted), "embed_hash", "left_semi"), "m")._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("BroadcastHashJoin") :]
    assert not re.search(r"(?<!Broadcast)Exchange hashpartitioning", below)


def test_a_writer_that_dies_leaves_the_version_before(spark, tmp_path, monkeypatch):
    store = index.ChunkStore(spark, str(tmp_path / "s"), buckets=4)
    rows = spark.range(20).select(F.lit("t").alias("source_type"), F.col("id").cast("string").alias("source_id"), F.col("id").alias("v"))
    store.write(rows)

    class Dies:
        def __init__(self, fs):
            self.fs = fs

        def create(self, *a):
            self.fs.create(*a).close()
            raise KeyboardInterrupt  # the list is there, but empty and without its name

        def __getattr__(self, name):
            return getattr(self.fs, name)

    monkeypatch.setattr(store, "fs", Dies(store.fs))
    with pytest.raises(KeyboardInterrupt):
        store.write(rows.limit(3))
    monkeypatch.undo()
    assert store.version() == 1 and store.read().count() == 20
    assert store.write(rows.limit(3)) == 2 and store.read().count() == 3
    with pytest.raises(Exception, match="exist"):
        store._commit(2, {})
    assert store.read().count() == 3


def test_words_on_one_message_within_a_batch(spark, tmp_path):
    """The greatest seq counts, however the rows lie; without the column a taken back message goes."""
    schema = "chat string, idx int, role string, content string, intermediate boolean, removed boolean"
    long = "that is long enough to be searched by its words"
    say = [("c", 0, "user", f"first {long}", False, False, 1), ("c", 0, "user", f"second {long}", False, False, 3), ("c", 0, "user", f"a third {long}", False, False, 2), ("c", 1, "assistant", f"answer {long}", False, False, 4), ("c", 2, "user", f"more {long}", False, False, 5)]
    for name, rows in (("up", say), ("down", say[::-1])):
        spark.createDataFrame(rows, schema + ", seq long").coalesce(1).write.parquet(str(tmp_path / name))
        log, store = index.ChunkStore(spark, str(tmp_path / f"{name}-log"), scope=("chat",)), index.ChunkStore(spark, str(tmp_path / f"{name}-store"))
        sync_messages(spark.readStream.schema(schema + ", seq long").parquet(str(tmp_path / name)), log, store, embed, "m", str(tmp_path / f"{name}-check")).awaitTermination()
        assert [r.content for r in log.read().where("idx = 0").collect()] == [f"second {long}"]
    both = [("c", 0, "user", f"kept {long}", False, False), ("c", 0, "user", None, None, True)]
    for name, rows in (("a", both), ("b", both[::-1])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / name))
        log, store = index.ChunkStore(spark, str(tmp_path / f"{name}-log"), scope=("chat",)), index.ChunkStore(spark, str(tmp_path / f"{name}-store"))
        sync_messages(spark.readStream.schema(schema).parquet(str(tmp_path / name)), log, store, embed, "m", str(tmp_path / f"{name}-check")).awaitTermination()
        assert log.read() is None or log.read().count() == 0
