import itertools
import random
from collections import OrderedDict

import pytest
from pyspark.sql import functions as F

from tessel.operators import caches, lanes, paging


def simulated(rows, capacity):
    out, held = [], {}
    for cache, seq, key in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2] is not None, r[2] or 0)):
        own = held.setdefault(cache, OrderedDict())
        hit = key in own
        own[key] = None
        own.move_to_end(key)
        out.append((cache, seq, key, hit, own.popitem(last=False)[0] if len(own) > capacity else None))
    return out


@pytest.mark.parametrize("capacity", [1, 3, 8])
def test_replay(spark, capacity):
    """One cache has most accesses and lies over all partitions; others are short; null keys and caches, repeated rows."""
    r = random.Random(capacity)
    rows = [("hot", k, r.randrange(14)) for k in range(4000)] + [(f"c{k % 50}", k, r.choice([None, 1, 2, 3, 4, 5, 6, 7, 8, 9])) for k in range(3000)] + [(None, k % 9, k % 4) for k in range(30)]
    df = spark.createDataFrame(rows, "cache string, seq long, key long").withColumns({"held": F.lit(1), "part": F.lit(2), "hit": F.lit(3)}).repartition(7)
    got = [tuple(x) for x in caches.replay(df, capacity).collect()]
    assert sorted(got, key=str) == sorted(simulated(rows, capacity), key=str) and {x[3] for x in got} == {True, False}


def test_replay_of_nothing(spark):
    assert caches.replay(spark.createDataFrame([], "cache string, seq long, key long")).count() == 0


def walk(pages, start):
    out, at = [], start
    while at in pages and at not in out:
        out.append(at)
        at = pages[at]
    return out


def test_walks(spark):
    """Chains, circles, tails into circles, missing pages, threads that share tokens: as a walk, in a logarithm of the rounds."""
    r = random.Random(4)
    threads = {f"t{k}": {j: r.choice([None, r.randrange(30), r.randrange(30)]) for j in range(r.randrange(1, 30))} for k in range(60)}
    threads["long"] = {k: k + 1 for k in range(3000)}
    threads["circle"] = {k: (k + 1) % 37 for k in range(37)}
    rows = [(t, a, b, [f"{t}-{a}-{c}" for c in range(a % 3)] if a % 5 else None) for t, own in threads.items() for a, b in own.items()]
    pages = spark.createDataFrame([*rows, (None, 1, 2, ["x"]), ("t0", None, 1, ["x"])], "thread string, token long, next long, comments array<string>").repartition(4)
    starts = spark.createDataFrame([(t, 0) for t in threads] + [("none", 0), ("long", 99999)], "thread string, token long")
    want = {(t, a): k for t, own in threads.items() for k, a in enumerate(walk(own, 0))}
    assert {(x.thread, x.token): x["rank"] for x in paging.walked(pages, starts).collect()} == want
    first = {}
    for t, own in threads.items():
        first[t] = list(itertools.islice((f"{t}-{a}-{c}" for a in walk(own, 0) if a % 5 for c in range(a % 3)), 25))
    got = {}
    for x in sorted(paging.collected(pages, starts, 25).collect(), key=lambda x: x.place):
        got.setdefault(x.thread, []).append(x.comment)
    assert got == {t: c for t, c in first.items() if c}


@pytest.mark.parametrize("seed,n", [(1, 1), (2, 3), (3, 10), (4, 40)])
def test_balanced(spark, seed, n):
    r = random.Random(seed)
    sizes = [r.choice([0, 1, 2, 5, 9, 60, 400, 3000]) for _ in range(400)] + [None, -4] + [9000] * 3
    rows = [(k if k % 50 else None, s, k) for k, s in enumerate(sizes)] + [(1, sizes[1], 1)] * 3
    df = spark.createDataFrame(rows, "id long, size long, at long").withColumn("lane", F.lit("x"))
    dealt = lanes.balanced(df, n).cache()
    got = dealt.collect()
    assert sorted((x.id or -1, x.size or 0, x.at) for x in got) == sorted((a or -1, b or 0, c) for a, b, c in rows) and all(0 <= x.lane < n for x in got)
    loads, plain = [0] * n, [0] * n
    for x in got:
        loads[x.lane] += max(x.size or 0, 0)
    for s in sorted((max(s or 0, 0) for _, s, _ in rows), reverse=True):  # longest first: no better than the best division
        plain[plain.index(min(plain))] += s
    assert max(loads) <= max(plain) * 4 / 3 + 1e-9
    assert [(x.lane, x["size"]) for x in lanes.loads(dealt.withColumn("size", F.greatest(F.coalesce("size", F.lit(0)), F.lit(0))), n).orderBy("lane").collect()] == list(enumerate(loads))
    dealt.unpersist()


def test_lanes_of_nothing(spark):
    none = spark.createDataFrame([], "id long, size long")
    assert lanes.balanced(none, 4).count() == 0 and lanes.loads(lanes.balanced(none, 4), 4).count() == 4
    with pytest.raises(ValueError):
        lanes.balanced(none, 0)


@pytest.mark.parametrize("block", [0, 2, 16, 4096])
def test_walks_of_long_and_short_threads_agree(spark, monkeypatch, block):
    """Threads are walked in a task up to a number of rows, and ranked by doubling beyond it; pages are shuffled once by the former."""
    monkeypatch.setattr(paging, "BLOCK", max(1, block))
    r = random.Random(9)
    threads = {k: {j: r.choice([None, r.randrange(20), j + 1]) for j in range(r.randrange(1, 40))} for k in range(40)}
    pages = spark.createDataFrame([(t, a, b) for t, own in threads.items() for a, b in own.items()] + [(0, 0, 5), (1, 0, None), (None, 1, 2)], "thread int, token int, next int")
    threads[0][0] = 5 if threads[0][0] is None else min(5, threads[0][0])
    starts = spark.createDataFrame([(t, 0) for t in threads] + [(99, 0), (0, None)], "thread int, token int")
    found = paging.walked(pages, starts)
    assert {(x.thread, x.token): x["rank"] for x in found.collect()} == {(t, a): k for t, own in threads.items() for k, a in enumerate(walk(own, 0))}
    if block == 4096:
        assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0
