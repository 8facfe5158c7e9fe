import re
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tessel.llm import interactions, queries
from tests import oracle

DOCS, LABELS = "doc_id long, text string, source string", "doc_id long, quality int, toxic int"
WORD = re.compile(r"[^ \t\n\x0b\x0c\r]+")


def want(docs, labels):
    good, toxic = {r[0] for r in labels if r[1] == 1}, {r[0] for r in labels if r[2] == 1}
    order = lambda k: (k is None, k or 0)
    failed = []
    for key, text, part in docs:
        text, words = text or "", WORD.findall(text or "")
        says = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search("[#$%&*|]", text)),
            "E": any((t or "") == text and order(k) < order(key) for k, t, _ in docs),
        }
        failed.append((part or "", {f for f in says if says[f]}, key is not None and key in good, key is not None and key in toxic))
    out, removed = {}, Counter()
    for part in {f[0] for f in failed}:
        for letters in map("".join, permutations("ABCDE")):
            left = [f for f in failed if f[0] == part]
            for k, x in enumerate(letters):
                here = [f for f in left if x in f[1]]
                gone = [f for f in failed if f[0] == part and x in f[1] and f[1] & set(letters[:k])]
                left = [f for f in left if x not in f[1]]
                only = sum(f[1] == {x} for f in failed if f[0] == part)
                out[part, letters, k + 1] = (len(left), len(here), len(gone), only, sum(f[2] for f in here), sum(f[3] for f in here))
                removed[part, x] += len(here)
    return {k: (*v, removed[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def collected(df):
    return {(r.part, r.filter_order, r.step): tuple(r[c] for c in [*interactions.COUNTS, "shapley"]) for r in df.collect()}


def corpus():
    many = " ".join(f"w{k}" for k in range(220))
    return [
        (1, many, "a"), (2, many, "b"), (2, many, "b"), (None, many, "a"), (None, None, None), (None, "", ""), (3, "", "a"), (4, "SHOUT " * 300, "a"), (5, "same " * 300, "b"), (6, "few words # here", "b"), (7, many + "\x0b$", None),
        (8, "Ünï A" * 50, "a"), (9, many.upper(), "c"), (9, "other text of the same id", "c"), (10, "x" * 3_000_000 + " " + many, "c"), (11, "v\tw " * 700_000, "c"),
    ]


def test_audit(spark):
    """Against a plain count: nulls, empties, repeated rows and ids, megabytes, parts without most masks, labels in conflict."""
    labels = [(1, 1, 0), (2, 1, None), (2, 0, 1), (4, None, 1), (9, 1, 1), (99, 1, 1), (None, 1, 1), (11, 1, 0)]
    docs = spark.createDataFrame(corpus(), DOCS).repartition(3).withColumns({c: F.lit("x") for c in ("id", "part", "mask", "n", "bits", "digest", "quality", "toxic")})
    got = collected(interactions.audit(docs, spark.createDataFrame(labels, LABELS).withColumn("source", F.lit(1))))
    assert got == want(corpus(), labels) and len(got) == 4 * 600


def test_own_filters(spark):
    """Any filters: two of one's own, and duplicates."""
    docs = spark.createDataFrame([(1, "a b", "s"), (2, "a b", "s"), (3, "b", "s")], DOCS)
    rows = interactions.audit(docs, spark.createDataFrame([], LABELS), {"A": lambda t: t.contains("a"), "B": lambda t: t.contains("b")}).collect()
    by = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in rows}
    assert by["AEB", 1][:3] == (1, 2, 0) and by["AEB", 2][:3] == (1, 0, 1)
    assert sorted({r.filter_order for r in rows}) == sorted(map("".join, permutations("ABE"))) and by["BEA", 1] == (0, 3, 0, 1, sum(r.removed for r in rows if r.filter_order[r.step - 1] == "B"))


def test_nothing(spark):
    assert interactions.audit(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).count() == 0


@pytest.mark.skipif(not oracle.available(), reason="the driver's tables are not here")
def test_query(spark):
    got, sql = queries.QUERIES["op12_filter_audit"](spark, oracle.SF).toPandas(), oracle.database().sql(queries.ORACLE["op12_filter_audit"]).df()
    assert sorted(got.columns) == sorted(sql.columns) and oracle.rows(got) == oracle.rows(sql)
