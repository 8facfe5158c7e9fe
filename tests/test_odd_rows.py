"""Queries and their SQL over rows that the driver's small tables do not hold."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tessel.plans import registry
from tests import oracle


def both(spark, folder, name, **tables):
    """The rows of a query and of its SQL over tables that are given as (rows, schema)."""
    con = duckdb.connect()
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    return oracle.rows(registry.QUERIES[name](spark, str(folder)).toPandas()), oracle.rows(con.sql(registry.ORACLE[name]).df())


def test_windows_of_no_provider_and_of_nothing_asked(spark, tmp_path):
    """Without a provider a model is local; a window of nothing or less is not one that was asked for."""
    rows = [(0, "BUILDING"), (1, "BUILDING"), (2, "BUILDING"), (-4, "BUILDING"), (4, None), (5, None), (6, "Ollama"), (7, "Machinery"), (8, ""), (9, "HOUSEHOLD")]
    got, want = both(spark, tmp_path, "context_windows", customer=(rows, "c_custkey long, c_mktsegment string"))
    assert got == want == sorted(((k, t) for k, t in ((0, 4096), (1, 4096), (2, 20), (-4, 4096), (4, 40), (5, 4096), (6, 60), (7, 200000), (8, 8192), (9, 8192))), key=lambda r: tuple(map(str, r)))


def test_situated_chunks_of_odd_texts(spark, tmp_path):
    """White space of any kind ends words and goes at the ends of a context."""
    texts = ["12345678\n\tab", "a b\t\r\ncdefghijk", "one\x0btwo threefour", "12345678 \x0bx", "", " ", "\n", "\t odd ", "é́🤦🏼‍♂️ x 👍🏽 yz", "x y  z abc", "123456789 a", "12345678  a b", "12345678 \u0085a b", "a\n\nb", "Excerpt:\nmore", "a\x00b c", None, "w " * 400 + "x"]
    rows = [(k, x) for k, t in enumerate(texts) for x in (t, t and t + "!")]
    got, want = both(spark, tmp_path, "situated_chunks", documents=([(None, "text"), *rows], "doc_id long, text string"))
    assert got == want and len(got) > 60


def test_situated_chunks_are_of_whole_documents(spark, tmp_path):
    """No word of a document is left out, neither before its end nor where it has blank lines."""
    docs = {k: [f"w{k}_{j}" for j in range(n)] for k, n in enumerate((1, 511, 512, 513, 960, 961, 5000))}
    rows = [(k, ("\n\n" if k % 2 else " ").join(w)) for k, w in docs.items()] + [(90, "a\n\nExcerpt:\nb"), (91, " \n\n "), (92, None)]
    got, want = both(spark, tmp_path, "situated_chunks", documents=(rows, "doc_id long, text string"))
    assert got == want  # (content, context, item_id)
    held = {k: {w for content, _, i in got if i == k for w in content.split()} for k in docs}
    assert held == {k: set(w) for k, w in docs.items()} and sum(len(content.split()) == 512 for content, _, _ in got) == 17
    assert {(content, context) for content, context, i in got if i == 90} == {("a Excerpt: b", "")} and [r for r in got if r[2] > 90] == [("", "", 91)]
    assert all(context == (f"w{i}_0~{content[:10].rstrip()}" if len(content) % 2 else "") for content, context, i in got if i in docs)


def test_write_back_of_odd_customers(spark, tmp_path):
    """Keys below zero and none at all, missing names and nations, and cells of one row that different tasks send."""
    rows = [(k, None if k % 7 == 0 else f"c{k}", None if k % 5 == 0 else k % 3, "m") for k in range(-60, 60)] + [(None, "n", 1, "m")]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = [tuple(r) for r in registry.QUERIES["write_back"](spark, str(tmp_path)).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    assert sorted(got, key=repr) == sorted(con.sql(registry.ORACLE["write_back"]).fetchall(), key=repr) and len(got) == len(rows)


def test_cosines_that_a_task_holds_are_bounded(monkeypatch):
    """A batch of any size goes through in products of CELLS cosines; ties at the edges of slices go to the smaller key."""
    import numpy as np
    import pyarrow as pa

    from tessel.operators import retrieval as R

    r, sizes, cosines = np.random.default_rng(4), [], R._cosines
    rows = np.repeat(r.integers(-2, 3, (60, 4)).astype(float), 5, axis=0)
    keys = r.permutation(len(rows))
    queries = r.integers(-2, 3, (7, 4)).astype(float)
    batch = pa.RecordBatch.from_arrays([pa.array(keys), pa.array(rows.tolist())], names=["key", "embedding"])
    monkeypatch.setattr(R, "_cosines", lambda b, c: sizes.append(len(c) * len(b.ids)) or cosines(b, c))
    found = {}
    for cells in (70, 10**6):
        monkeypatch.setattr(R, "CELLS", cells, raising=False)
        sizes.clear()
        found[cells] = [tuple(x.values()) for b in R._keep_best(R.Block(list(range(7)), queries.tolist()), 6, [batch, batch.slice(0, 0)]) for x in b.to_pylist()]
        assert max(sizes) <= cells
    want = cosines(R.Block(list(range(7)), queries.tolist()), batch.column(1)).round(9)
    assert found[70] == found[10**6] == [(q, k, -s) for q in range(7) for s, k in sorted(zip(-want[:, q], keys.tolist()))[:6]]


def _plain_bm25(rows, asked, top_k):
    """By corpus, as the SQL: rows of one key and length are one, of one key and several lengths add up."""
    from collections import Counter, defaultdict
    from math import log

    found = defaultdict(float)
    for corpus in {c for c, _, _ in rows if c is not None}:
        own = [(k, (t or "").lower().split()) for c, k, t in rows if c == corpus]
        avgdl, tf = sum(len(t) for _, t in own) / len(own) or 1.0, Counter((w, k, len(t)) for k, t in own for w in t)
        df = Counter(w for w, _, _ in tf)
        for q, text in asked:
            for (w, k, dl), n in tf.items():
                if w in set((text or "").lower().split()):
                    found[q, corpus, k] += log(1 + (len(own) - df[w] + 0.5) / (df[w] + 0.5)) * n * 2.5 / (n + 1.5 * (0.25 + 0.75 * dl / avgdl))
    lists = defaultdict(list)
    for (q, c, k), score in found.items():
        lists[q, c].append((-round(score, 9), k is not None, k or "", score))
    return sorted((q, c, k or None, rank, round(score, 7)) for (q, c), own in lists.items() for rank, (_, _, k, score) in enumerate(sorted(own)[:top_k]))


@pytest.mark.parametrize("block,cells,held,common", [(1000, 10**6, 10**6, 0.002), (2, 64, 10**6, 0.0), (3, 40, 0, 2.0), (2, 10**6, 3, 0.1)])
def test_keyword_search_in_blocks(spark, monkeypatch, block, cells, held, common):
    """Any block of queries, slice of rows, vocabulary and share of common terms gives what plain Python gives: repeated and null
    keys, null texts and corpora, ties, unknown and blank queries included."""
    import random

    from tessel.operators import retrieval as R

    for name, value in (("BLOCK", block), ("CELLS", cells), ("HELD", held), ("COMMON", common)):
        monkeypatch.setattr(R, name, value)
    r = random.Random(7)
    text = lambda n: " ".join(r.choice(["the", "The", *(f"w{k}" for k in range(25))]) for _ in range(n))
    rows = [(r.choice("abc"), f"k{i:03}", text(r.randrange(0, 12))) for i in range(120)]
    rows += [("a", "k001", "the w1 w1"), ("a", "k001", "w2 w3 the"), ("a", "k001", "w1"), ("b", "same", "w5 the"), ("b", "same", "w5 the"), ("c", None, "w6 w7"), ("c", "", None), (None, "k5", "the w1")]
    asked = [*((k, text(5)) for k in range(6)), (7, "the"), (8, "nothing known"), (9, " "), (10, None)]
    df, queries = spark.createDataFrame(rows, "corpus string, id string, content string").repartition(3), spark.createDataFrame(asked, "query int, q string")
    got = R.bm25(df, queries, 4, corpus=["corpus"])
    assert sorted((x["query"], x.corpus, x.id, x["rank"], round(x.score, 7)) for x in got.collect()) == _plain_bm25(rows, asked, 4)


def test_frequent_terms_are_not_shuffled(spark):
    """What is shuffled for a keyword search follows the tasks and the best rows, not the rows that hold a term."""
    from tessel.operators import retrieval as R

    shuffled = []
    for n in (2000, 8000):
        df = spark.range(0, n, 1, 2).select("id", F.concat(F.lit("the of w"), F.col("id") % 50).alias("content"))
        found = R.bm25(df, ["the of", "the w1"], 5)
        assert found.count() == 10
        plan = found._jdf.queryExecution().toString().split("== Optimized Logical Plan ==")[1]
        shuffled.append(plan.count("Join"))
    assert shuffled == [0, 0]
