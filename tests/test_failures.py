import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessel.operators import ann, batch, feeds, index, ladders, personas, pool, runs
from tessel.operators.retrieval import vector_search
from tessel.plans import polling as plans
from tessel.sources import manifests
from tessel.streaming import polling
from tests import oracle


def test_lanes_are_set_aside_and_bad_inputs_fail_alone():
    asked = []

    def call(lane, inputs):
        asked.append(lane)
        if lane == "b" or "bad" in inputs:
            raise RuntimeError
        return [x.upper() for x in inputs]

    lanes = pool._Lanes(["a", "b"], call, patience=2, first=0)
    for _ in range(10):
        assert lanes.ask(["x", "y"], []) == [("X", "a"), ("Y", "a")]
    assert asked.count("b") == 2  # then it is down
    tries = []
    assert lanes.ask(["x", "bad", "y", "z"], tries) == [("X", "a"), (None, None), ("Y", "a"), ("Z", "a")]
    assert lanes.missed["a"] == 0 and sum(t["inputs"] for t in tries if t["ok"]) == 3
    short = pool._Lanes(["a"], lambda lane, inputs: ["one"], 3, 0)
    assert short.ask(["x", "y"], []) == [("one", "a"), ("one", "a")]  # an answer too few is a failure, halves are not


def test_pool_over_a_table(spark):
    def call(lane, inputs):
        if lane == "down":
            raise OSError
        return [None if x is None else float(len(x)) for x in inputs]

    df = spark.createDataFrame([(k, "x" * k if k else None) for k in range(300)], "id long, text string").repartition(3)
    got = pool.asked(df, "text", call, ["down", "up"], answer="double", batch=10, patience=2)
    rows = {r["id"]: r for r in got.collect()}
    assert len(rows) == 300 and all(r["ok"] and r["lane"] == "up" for r in rows.values()) and rows[7]["answer"] == 7.0 and rows[0]["answer"] is None
    sums = {r["lane"]: r for r in pool.throughput(got).collect()}
    assert sums["up"]["inputs"] == 300 and sums["up"]["failures"] == 0 and sums["down"]["inputs"] == 0 and sums["down"]["failures"] == sums["down"]["tries"] <= 6
    assert pool.asked(df.limit(0), "text", call, ["up"], answer="double").count() == 0


def test_manifests_find_damage_and_nothing_is_written_over_it(spark, tmp_path):
    path = str(tmp_path / "store")
    df = spark.range(100).select("id", F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("text")).repartition(4)
    manifests.written(df, path)
    assert {(r.state, r.rows == r.found) for r in manifests.check(spark, path).collect()} == {("ok", True)}
    assert manifests.opened(spark, path).count() == 100
    files = sorted((tmp_path / "store").glob("*.parquet"))
    data = files[0].read_bytes()
    files[0].write_bytes(data[: len(data) // 2])
    files[1].unlink()
    for f in (tmp_path / "store").glob(".*.crc"):
        f.unlink()
    spark.catalog.clearCache()
    states = {r.file: r.state for r in manifests.check(spark, path).collect()}
    assert states[files[0].name] == "damaged" and states[files[1].name] == "missing" and sorted(states.values()) == ["damaged", "missing", "ok", "ok"]
    for use in (lambda: manifests.opened(spark, path), lambda: manifests.written(df, path)):
        with pytest.raises(manifests.DamagedStore, match="1 damaged.*1 missing"):
            use()
    assert len(list((tmp_path / "store").glob("*.parquet"))) == 3  # as it was


def test_whole_stores_are_written_anew_and_changed_rows_are_seen(spark, tmp_path):
    path = str(tmp_path / "store")
    manifests.written(spark.range(10).coalesce(1), path)
    manifests.written(manifests.opened(spark, path).where("id < 4"), path)  # from itself
    assert manifests.opened(spark, path).count() == 4
    file = next((tmp_path / "store").glob("*.parquet"))
    other = tmp_path / "other"
    spark.range(4, 8).coalesce(1).write.parquet(str(other))
    for f in (tmp_path / "store").glob(".*.crc"):
        f.unlink()
    file.write_bytes(next(other.glob("*.parquet")).read_bytes())
    assert [r.state for r in manifests.check(spark, path).collect()] == ["damaged"]  # as many rows, but others
    spark.range(3).write.parquet(str(tmp_path / "unknown"))
    with pytest.raises(manifests.DamagedStore, match="without a manifest"):
        manifests.written(spark.range(1), str(tmp_path / "unknown"))


def test_a_compile_that_is_cancelled_leaves_the_version_before(spark, tmp_path):
    store = index.ChunkStore(spark, str(tmp_path / "s"), buckets=2, scope=("id",))
    store.write(spark.range(5))
    run, seen = runs.Run(spark, "compile"), []

    @F.udf("long")
    def slow(x):
        time.sleep(0.5)
        return x

    def steps(s, _):
        seen.append("slow")
        return store.write(s.range(0, 4000, 1, 4).select(slow("id").alias("id")))

    threading.Timer(3, run.cancel).start()
    began = time.monotonic()
    with pytest.raises(runs.Cancelled, match="step 1 of 2"):
        run.start([steps, lambda s, v: seen.append("never")])
    assert time.monotonic() - began < 60 and seen == ["slow"] and store.version() == 1 and store.read().count() == 5
    with pytest.raises(runs.Cancelled, match="before step 1"):
        run.start([steps])
    assert runs.Run(spark).start([lambda s, v: s.range(3).count(), lambda s, v: v + 1]) == 4


def test_streams_of_a_run_stop(spark, tmp_path):
    run = runs.Run(spark)
    q = run.watch(spark.readStream.format("rate").load().writeStream.format("noop").option("checkpointLocation", str(tmp_path)).start())
    run.cancel()
    run.cancel()
    q.awaitTermination(30)
    assert not q.isActive
    run._ended.set()


FETCHES = [("f", 1, 500, None, None), ("f", 2, 304, None, None), ("f", 3, 200, "e1", "one"), ("f", 4, 304, "e1", None), ("f", 5, 200, "e2", "one"), ("f", 6, 503, None, None), ("f", 7, None, None, None), ("f", 8, 200, None, "two"), ("f", 9, 200, "e3", "one"), ("g", 5, 200, None, None)]
STATES = ["failed", "failed", "new", "same", "same", "cached", "cached", "new", "new", "new"]


def test_listings_of_a_table(spark):
    df = spark.createDataFrame(FETCHES, "feed string, at long, status int, etag string, body string")
    got = polling.listings(df).orderBy("feed", "at").collect()
    assert [r.state for r in got] == STATES and [r.listing for r in got] == [None, None, 3, 3, 3, 3, 3, 8, 9, 5]
    assert got[0].warning.endswith("no listing was read before.") and "503" in got[5].warning and "no answer" in got[6].warning and got[2].warning is None


def test_polls_of_a_stream_over_batches(spark, tmp_path):
    schema = "feed string, at long, status int, etag string, body string"
    (tmp_path / "in").mkdir()
    stream = polling.polled(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")))
    out = str(tmp_path / "out")
    for k in range(0, len(FETCHES), 4):  # a restart between any two, the state comes from the checkpoint
        spark.createDataFrame(FETCHES[k : k + 4], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(out).orderBy("feed", "at").collect()
    assert [r.state for r in got] == STATES and [r.body for r in got] == [None, None, "one", None, None, None, None, "two", "one", ""]
    assert [r.listing for r in got] == [None, None, 3, 3, 3, 3, 3, 8, 9, 5] and [r.etag for r in got][2:9] == ["e1", "e1", "e2", "e2", "e2", "e2", "e3"]
    assert [bool(r.warning) for r in got] == [s in ("failed", "cached") for s in STATES]


def test_why_nothing_passed(spark):
    rows = [("a", 1, ["News", " "], "x"), ("a", 2, ["news"], "y"), ("a", 3, ["Art"], "y"), ("b", 1, None, "y"), ("b", 2, [], "y"), ("c", 1, ["Sport"], "z")]
    df = spark.createDataFrame(rows, "feed string, pos int, categories array<string>, haystack string")
    got = {r.feed: r for r in feeds.filter_report(df, categories="sport", exclude="q").collect()}
    assert got["a"].terms == ["News", "Art"] and "News, Art" in got["a"].reason and "categories sport; without q" in got["a"].reason and (got["a"].total, got["a"].matched, got["a"].categorised) == (3, 0, 3)
    assert "no categories" in got["b"].reason and got["b"].terms == [] and got["c"].reason is None and got["c"].matched == 1
    assert "fewer terms" in {r.feed: r for r in feeds.filter_report(df, keywords="nothing").collect()}["a"].reason


def test_ladders_fall_by_half(spark):
    rows = [(1, "t", 0, False, None), (1, "t", 1, True, " "), (1, "t", 2, True, "words"), (1, "t", 3, False, None), (1, "c", 0, True, "kept"), (2, "t", 1, False, "x"), (2, "t", 2, None, "y")]
    got = {(r.id, r.half): (r.rung, r.value, r.failed, r.write) for r in ladders.best_attempts(spark.createDataFrame(rows, "id int, half string, rung int, ok boolean, value string")).collect()}
    assert got == {(1, "t"): (2, "words", 2, True), (1, "c"): (0, "kept", 0, False), (2, "t"): (None, None, 2, False)}


def test_forget_under_every_backend(spark):
    keys = ["library:a", "library:a@x", "library:a@x@y", "library:ab", "persona:a", "library:b@c", "library:b@c@x", "library:b"]
    gone = spark.createDataFrame([("library", "a"), ("library", "b@c")], "kind string, id string")
    got = index.forget(spark.createDataFrame([(k,) for k in keys], "key string"), gone)
    assert sorted(r.key for r in got.collect()) == ["library:a@x@y", "library:ab", "library:b", "persona:a"]


def test_a_folder_of_prompts(spark, tmp_path):
    for name, text in (("a.txt", "one"), ("b.md", " two "), ("c.md", " \n"), ("d.txt", "silent"), ("e.pdf", "x")):
        (tmp_path / name).write_text(text)
    ask = lambda p: p.where("prompt <> 'silent'").select("path", F.upper("prompt").alias("response"))
    for _ in range(2):  # answers are no prompts of the next run
        got = {r.path.rsplit("/", 1)[-1]: (r.ok, r.error) for r in batch.answered_folder(spark, str(tmp_path), ask).collect()}
        assert got == {"a.txt": (True, None), "b.md": (True, None), "c.md": (False, "empty prompt"), "d.txt": (False, "no answer")}
    assert sorted((p.name, p.read_text()) for p in (tmp_path / "responses").glob("*.*") if not p.name.startswith(".")) == [("a.txt", "ONE"), ("b.md", "TWO")]


def test_personas_are_compiled_in_one(spark):
    files = spark.createDataFrame([("p", "x/one", True, "words of a file"), ("p", "bad", False, None)], "persona string, path string, ok boolean, text string")
    memories = spark.createDataFrame([("p", "one", "title", "what is known")], "persona string, id string, title string, description string")
    asked = []

    def embed(df):
        asked.append(df.count())
        return df.select("embed_hash", F.array(F.lit(1.0).cast("float")).alias("embedding"))

    stored = index.with_vectors(index.chunk_items(personas.knowledge_items(files.limit(0))), _empty(spark), embed, "m").drop("reused")
    old = index.manifest(personas.knowledge_items(files.limit(0)), index.completeness(stored), "s")
    store, made = personas.compile_persona(files, memories, stored, old, embed, "m")
    assert sorted((r.source_type, r.item_id) for r in store.collect()) == [("persona_knowledge", "k:one"), ("persona_memory", "m:one")] and made.count() == 2
    store, made = personas.compile_persona(files, memories.limit(0), store, made, embed, "m")
    assert [r.item_id for r in store.collect()] == ["k:one"] and made.count() == 1 and asked[-1] == 0


def _empty(spark):
    return spark.createDataFrame([], "id string, embed_hash string, embedding array<float>, model string")


def test_lists_keep_their_recall_after_writes(spark):
    if not oracle.available():
        pytest.skip("the driver's tables are not here")
    assigned, centroids = plans.after_writes(spark, "/root/testdata/sf0.1")
    assigned = assigned.persist()
    now = ann.live(assigned).select("vec_id", "embedding")
    queries = now.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), "embedding")
    want = {(r["query"], r["vec_id"]) for r in vector_search(now, queries, 10, "vec_id", "embedding").collect()}
    got = {(r["query"], r["vec_id"]) for r in ann.search(assigned, centroids, queries, 10, probes=12 * len(centroids) // 16, key="vec_id", least=0).collect()}
    assert len(want & got) / len(want) >= 0.9
    assert now.groupBy("vec_id").count().where("count > 1").count() == 0
    assigned.unpersist()


def test_lists_are_split_and_swept_where_due(spark):
    rng = np.random.default_rng(1)
    rows = [(k, (np.eye(4)[k % 2] + rng.normal(0, 0.05, 4)).tolist()) for k in range(200)] + [(1000 + k, (np.eye(4)[2] + rng.normal(0, 0.05, 4)).tolist()) for k in range(40)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    centroids = [[0.7, 0.7, 0.0, 0.0], [0.0, 0.0, 1.0, 0.0]]
    first = ann.changed(ann.assign(df, centroids), centroids, df.limit(0), df.where("id % 10 = 3").select("id"))
    assert {(r.list, r.rows, r.dead, r.split, r.sweep) for r in ann.due(first, grown=1.4).collect()} == {(0, 180, 20, True, False)}
    after, cs = ann.rebuilt(first, centroids, grown=1.4)
    lists = {r["list"]: r["n"] for r in after.groupBy("list").agg(F.count("*").alias("n")).collect()}
    assert len(cs) == 3 and cs[1] == centroids[1] and sorted(lists.values()) == [40, 80, 100] and after.where("not live").count() == 4
    again, same = ann.rebuilt(after, cs, grown=5.0)
    assert same == cs and again.where("not live").count() == 4
