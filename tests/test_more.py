import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessel.operators import ann, feeds, render, retrieval
from tessel.plans import registry
from tests import oracle


@pytest.mark.skipif(not oracle.available(), reason="the driver's tables are not here")
@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.1"])
def test_recall_of_the_registered_probes(spark, sf):
    """Every twentieth vector asks, with the lists and probes of the query, each in its own lists only."""
    have = spark.read.parquet(f"{sf}/embeddings.parquet")
    asked = have.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), "embedding")
    key = lambda df: {(r["query"], r.vec_id) for r in df.collect()}
    exact, found = key(retrieval.vector_search(have, asked, 10, "vec_id")), key(registry.QUERIES["ann_topk"](spark, sf))
    assert len(exact) == 10 * asked.count() and len(found & exact) / len(exact) >= 0.9


def test_a_query_looks_into_its_own_lists_only(spark):
    rows = spark.createDataFrame([(k, [float(np.cos(k)), float(np.sin(k))]) for k in range(400)], "id long, embedding array<float>")
    centroids = ann.fit(rows, 10)
    assigned = ann.assign(rows, centroids)
    asked = [[1.0, 0.0], [0.0, 1.0], [-1.0, 0.0]]
    lists = {r.id: r["list"] for r in assigned.collect()}
    found = ann.search(assigned, centroids, asked, 5, probes=1, least=0).collect()
    assert len(found) == 15
    for k, v in enumerate(asked):
        nearest = int(np.argmin(((np.array(centroids) - v) ** 2).sum(axis=1)))
        own = sorted((-round(float(np.dot(v, [np.float32(np.cos(i)), np.float32(np.sin(i))]) / np.hypot(np.float32(np.cos(i)), np.float32(np.sin(i)))), 9), i) for i in lists if lists[i] == nearest)[:5]
        assert [r.id for r in sorted((r for r in found if r["query"] == k), key=lambda r: r["rank"])] == [i for _, i in own]
    assert {r["query"]: r.n for r in ann.search(assigned, centroids, asked, 60, probes=1, least=0).groupBy("query").agg(F.count("*").alias("n")).collect()} == {0: 60, 1: 60, 2: 60}  # short lists: all rows
    exact = retrieval.vector_search(rows, asked, 5).collect()
    assert sorted(ann.search(assigned, centroids, asked, 5, probes=1).collect()) == sorted(exact)  # few rows: as they are


def test_samples_of_huge_tables_are_not_empty(spark):
    from tessel.tables import sampled

    got = sampled(spark.range(2_000_000), 10**11, 10**6, "s", "id").count()
    assert 2 <= got <= 60  # a hundred-thousandth, of a table that says it has 1e11 rows
    assert sampled(spark.range(10), 10, 10, "s", "id").count() == 10


def test_vectors_against_plain(spark, monkeypatch):
    """Ties, repeated rows, zero and odd vectors, string keys, many blocks and batches."""
    monkeypatch.setattr(retrieval, "BLOCK", 3)
    r = np.random.default_rng(2)
    rows = [(f"k{k:03d}", [float(x) for x in r.integers(-2, 3, 4)]) for k in range(300)] + [("none", None), ("empty", []), ("odd", [1.0])]
    asked = [(7 * k, [float(x) for x in r.integers(-2, 3, 4)]) for k in range(11)] + [(1, []), (2, None)]
    got = retrieval.vector_search(spark.createDataFrame(rows, "id string, embedding array<float>").repartition(3), spark.createDataFrame(asked, "query long, embedding array<double>"), 7)

    def cos(a, b):
        n = np.linalg.norm(a) * np.linalg.norm(b) if len(a) == len(b) else 0
        return round(float(np.dot(a, b) / n), 9) if n else -1.0

    want = [(q, i, s, k) for q, v in asked if v for k, (s, i) in enumerate(sorted(((cos(v, x), i) for i, x in rows if x), key=lambda t: (-t[0], t[1]))[:7])]
    assert sorted((x["query"], x.id, x.score, x["rank"]) for x in got.collect()) == sorted(want)


def test_comments_and_passages(spark):
    payload = json.dumps({"a": [{"author": "x", "text": " hi "}, {"b": {"author": "x", "text": " hi "}}, {"author": "y", "text": "yo"}, {"author": 1, "text": "no"}]})
    got = spark.createDataFrame([(payload,), ("bad",), (None,)], "p string").select(render.comments("p").alias("c")).collect()
    assert [[(c.author, c.text) for c in r.c] for r in got] == [[("x", "hi"), ("y", "yo")], [], []]
    doc = "One two\n three four five six seven eight nine ten"
    cases = [("two\n three", [4, 14]), ("two three", [4, 14]), ("three four five six seven eight nine ten but not this", [9, 49]), ("not this three four five", None), ("five six seven eight nine ten", [20, 49]), ("", None)]
    df = spark.createDataFrame([(doc, p) for p, _ in cases], "d string, p string")
    assert [r.x for r in df.select(render.locate("d", "p").alias("x")).collect()] == [w for _, w in cases]


def test_messages_without_a_user_turn_get_it_at_the_end(spark):
    df = spark.createDataFrame([([("system", "s"), ("assistant", "a")],), ([("user", "1"), ("user", "2"), ("assistant", "a")],), ([],)], f"m {render.MESSAGES}")
    extra = F.struct(F.lit("x").alias("role"), F.lit("e").alias("content"))
    assert [[m.role for m in r.m] for r in df.select(render.before_last_user(F.col("m"), extra).alias("m")).collect()] == [["system", "assistant", "x"], ["user", "x", "user", "assistant"], ["x"]]


def test_ids_that_are_not_mapped_stay(spark):
    r = spark.range(1).select(render.remapped(F.array(F.lit("a"), F.lit("b")), F.create_map(F.lit("a"), F.lit("z"))).alias("x"), render.addresses(F.lit(5), F.lit(4)).alias("y"), render.has_keys(F.lit("[1]"), ["k"]).alias("k")).first()
    assert (r.x, r.y, r.k) == (["z", "b"], None, False)


def test_coverage(spark):
    ask = lambda **k: feeds.covered(*[F.lit(k.get(c)).cast(t) for c, t in (("advertised", "string"), ("transcript", "string"), ("source", "string"), ("known", "string"), ("missing", "boolean"))], F.lit(k.get("asr", False)))
    r = spark.range(1).select(ask(advertised="u", known="v", transcript="t", source="asr"), ask(transcript="t"), ask(missing=True), ask(missing=True, asr=True), ask()).first()
    assert list(r) == [False, True, True, False, False]


def test_postings_on_disk_answer_like_a_scan(spark, tmp_path):
    from tessel.operators import postings

    rows = spark.createDataFrame([("a", "the cat sat"), ("b", "The dog, the dog!"), ("c", ""), ("d", "cat's cat 9")], "id string, content string")
    postings.write(*postings.build(rows), str(tmp_path))
    asked = ["cat the", "dog's", " "]
    plain = lambda df: {(r["query"], r.id, round(r.score, 9), r["rank"]) for r in df.collect()}
    stored, totals = postings.read(spark, str(tmp_path))
    assert plain(postings.search(stored, totals, asked)) == plain(retrieval.bm25(rows, asked)) != set()
    assert postings.search(stored, totals, [""]).count() == 0


def test_queries_beyond_a_thousand_keep_their_ids(spark):
    rows = spark.createDataFrame([(k, f"w{k} and more") for k in range(1500)], "id long, content string")
    asked = spark.createDataFrame([(7, None), (8, " ")] + [(10 * k, f"w{k}") for k in range(1500)], "query long, q string")
    assert {(r["query"], r.id) for r in retrieval.bm25(rows, asked).collect()} == {(10 * k, k) for k in range(1500)}
    assert {(r["query"], r.id) for r in retrieval.bm25(rows, [f"w{k}" for k in range(1500)]).collect()} == {(k, k) for k in range(1500)}


def test_vectors_beyond_a_block(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK", 4)
    rows = spark.createDataFrame([(k, [float(np.cos(k)), float(np.sin(k))]) for k in range(10)], "id long, embedding array<float>")
    found = retrieval.vector_search(rows, [[float(np.cos(k)), float(np.sin(k))] for k in range(10)], 1)
    assert sorted((r["query"], r.id) for r in found.collect()) == [(k, k) for k in range(10)]


def test_rows_are_assigned_once(spark, monkeypatch):
    """However many blocks of queries there are, every row is put into its list once; rows without direction are in the first."""
    from tessel.operators import retrieval as R

    monkeypatch.setattr(R, "BLOCK", 5)
    rows = [(k, [float(np.cos(k)), float(np.sin(k))]) for k in range(60)] + [(60, [0.0, 0.0]), (61, [1.0]), (62, [None, 1.0])]
    df, centroids, seen = spark.createDataFrame(rows, "id long, embedding array<float>"), [[1.0, 0.0], [-1.0, 0.0], [0.0, 1.0]], spark.sparkContext.accumulator(0)
    lists = {r.id: r["list"] for r in ann.assign(df, centroids).collect()}
    assert [lists[k] for k in (0, 3, 2, 60, 61, 62)] == [0, 1, 2, 0, 0, 0]

    @F.udf("long")
    def counted(x):
        seen.add(1)
        return x

    asked = spark.createDataFrame([(k, [float(np.cos(k)), float(np.sin(k))]) for k in range(20)], "query long, embedding array<float>")
    found = ann.search(ann.assign(df.withColumn("id", counted.asNondeterministic()("id")), centroids), centroids, asked, 3, probes=1, least=0)
    assert found.count() == 60 and seen.value == len(rows)
