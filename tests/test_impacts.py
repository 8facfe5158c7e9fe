import random

import pytest
from pyspark.sql import functions as F

from tessel.operators import postings, retrieval


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    pool = [f"w{k}" for k in range(3000)]
    out = []
    for k in range(6000):
        words = [r.choice(pool) for _ in range(r.randrange(3, 30))] + ["the"] * r.choice((1, 1, 1, 2, 6)) + ["of"] * (k % 2)
        r.shuffle(words)
        out.append((k, " ".join(words)))
    return [*out, (9001, None), (9002, ""), (9003, "the the the"), (9004, "the the the")]


QUESTIONS = ["the w1 w2", "the of", "w5 w6 w7 w8 the of", "nothing known", "the", " ", "THE w1"]


@pytest.fixture(scope="module")
def tables(spark, rows, tmp_path_factory):
    df = spark.createDataFrame(rows, "id long, content string")
    path = str(tmp_path_factory.mktemp("index"))
    postings.write_blocks(postings.build_blocks(*postings.build(df)), path)
    return df, postings.read_blocks(spark, path)


@pytest.mark.parametrize("first,more,top_k", [(256, 8, 10), (16, 2, 5), (1, 64, 3), (10**6, 8, 10)])
def test_same_ranks(spark, tables, monkeypatch, first, more, top_k):
    monkeypatch.setattr(postings, "FIRST", first)
    monkeypatch.setattr(postings, "MORE", more)
    df, index = tables
    listed = lambda x: sorted((r["query"], r["rank"], r.id, round(r.score, 9)) for r in x.collect())
    found, _ = postings.search_blocks(index, QUESTIONS, top_k)
    assert listed(found) == listed(retrieval.bm25(df, QUESTIONS, top_k)) and len(listed(found)) > 4 * top_k


def test_frequent_terms_stay_unread(spark, rows, tables):
    """Twice as many rows with a stop word: nothing more is read of it beside rare terms, and a small share of it alone."""
    _, index = tables
    read = {(r["query"], r.term): r.n for r in postings.search_blocks(index, QUESTIONS, 3)[1].collect()}
    held = sum("the" in (t or "").split() for _, t in rows)
    assert held > 6000 and read[0, "the"] < held / 4 and read[0, "w1"] > 0 and (3, "nothing") not in read
    more = spark.createDataFrame([(10_000 + k, t) for k, t in rows if "w1" not in (t or "").split() and "w2" not in (t or "").split()], "id long, content string")
    both = spark.createDataFrame(rows, "id long, content string").unionByName(more)
    twice = {(r["query"], r.term): r.n for r in postings.search_blocks(postings.build_blocks(*postings.build(both)), QUESTIONS[:1], 3)[1].collect()}
    assert twice[0, "the"] <= 2 * read[0, "the"] and twice[0, "the"] < held / 4


def test_nothing(spark):
    none = spark.createDataFrame([], "id long, content string")
    found, read = postings.search_blocks(postings.build_blocks(*postings.build(none)), ["a b"], 3)
    assert found.count() == read.count() == 0
    one = spark.createDataFrame([(1, "a")], "id long, content string")
    assert postings.search_blocks(postings.build_blocks(*postings.build(one)), spark.createDataFrame([("x", "a"), ("y", None)], "query string, q string"), 3)[0].select("query", "id", F.col("rank")).collect() == [("x", 1, 0)]


def test_postings_are_not_shuffled_for_blocks(spark):
    """Blocks come from whole rows, which are shuffled once by key; rows of one key and two lengths add up."""
    df = spark.createDataFrame([("a", "x y x"), ("a", "x"), ("a", "y x x"), ("b", "z y"), ("c", None)], "id string, content string")
    assert sorted((r.id, r.dl, sorted(map(tuple, r.counts))) for r in postings.counted(df).collect()) == [("a", 1, [("x", 1)]), ("a", 3, [("x", 4), ("y", 2)]), ("b", 2, [("y", 1), ("z", 1)])]
    index = postings.blocks_of(postings.counted(df), postings.totals_of(df))
    plan = index["blocks"]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    listed = lambda x: sorted((r["query"], r["rank"], r.id, round(r.score, 9)) for r in x.collect())
    assert listed(postings.search_blocks(index, ["x y", "z"], 3)[0]) == listed(retrieval.bm25(df, ["x y", "z"], 3)) != []
