import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessel.llm import neighbours, queries
from tests import oracle

KIND = "vec_id long, embedding array<float>, label int"


def cosine(a, b):
    a, b = np.asarray(a, dtype=np.float64), np.asarray(b, dtype=np.float64)
    return float((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())))


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)


def want(rows, ask, top_k=5):
    rows = sorted({(k, tuple(np.float32(v).tolist())) for k, v, *_ in rows if k is not None and usable(v)})
    out = {}
    for key in {k for k, _ in rows if ask(k)}:
        q = min(v for k, v in rows if k == key)
        near = sorted((-cosine(q, v), k) for k, v in rows if k != key and len(v) == len(q))
        out[key] = [(k, -s) for s, k in near[:top_k]]
    return out


def collected(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert all([x[0] for x in v] == list(range(1, len(v) + 1)) for v in out.values())
    return {k: [x[1:] for x in v] for k, v in out.items()}


def same(got, want):
    assert got.keys() == {k for k, v in want.items() if v}
    for k in got:
        assert [x[0] for x in got[k]] == [x[0] for x in want[k]]
        assert np.allclose([x[1] for x in got[k]], [x[1] for x in want[k]], rtol=0, atol=1e-12)


def test_balanced_parts():
    """Clusters of unequal sizes: no part beyond its room, and far fewer edges cut than by chance."""
    r = np.random.default_rng(4)
    centres = r.normal(size=(9, 16)) * 3
    u = neighbours.units(np.concatenate([c + r.normal(size=(n, 16)) for c, n in zip(centres, [300, 20, 60, 90, 150, 30, 200, 100, 50])]))
    graph = neighbours.neighbour_graph(u, 8)
    s = u @ u.T - 9 * np.eye(len(u))
    assert (np.sort(np.take_along_axis(s, graph, 1), 1) == np.sort(s, axis=1)[:, -8:]).all()
    part = neighbours.balanced_parts(graph, 8)
    assert np.bincount(part, minlength=8).max() <= max(math.ceil(len(u) / 8), int(neighbours.SLACK * len(u) / 8))
    assert (part[graph] == part[:, None]).mean() > 0.6


def test_routing_finds_what_it_promises():
    """Clustered vectors: unseen queries reach 0.9 or more of their neighbours in a third of the parts or less."""
    r = np.random.default_rng(5)
    centres = r.normal(size=(40, 24)) * 2
    x = centres[r.integers(0, 40, 4000)] + r.normal(size=(4000, 24))
    router = neighbours.route_sample(x[:2500])
    u, q = neighbours.units(x), x[2500:]
    s = neighbours.units(q) @ u.T
    s[np.arange(1500), np.arange(2500, 4000)] = -9
    parts, near = router.parts_of(x), np.argsort(-s, axis=1)[:, :5]
    probes = router.probes(q)
    assert np.mean([parts[j] in p for p, js in zip(probes, near) for j in js]) >= 0.9
    assert np.mean([len(p) for p in probes]) < len(router.weights[3]) / 3 and len(router.weights[3]) > 8


@pytest.mark.parametrize("rows,asked,grid", [(2048, 512, 32), (7, 3, 1), (16, 2, 2)])
def test_exact_within_what_is_reached(spark, rows, asked, grid, monkeypatch):
    """All parts probed: copies, ties, scaled copies, repeated rows, shared ids, several widths, unusable vectors, any blocks."""
    for name, value in (("ROWS", rows), ("ASKED", asked), ("GRID", grid)):
        monkeypatch.setattr(neighbours, name, value)
    r = np.random.default_rng(rows)
    data = [(k, r.normal(size=8).tolist(), 0) for k in range(300)]
    data += [(k, data[0][1], 0) for k in range(400, 440)] + [(k, [x * 4 for x in data[0][1]], 0) for k in range(440, 450)]
    data += [data[50]] * 30 + [(100, r.normal(size=8).tolist(), 0), (7, data[8][1], 1)]
    data += [(k, r.normal(size=3).tolist(), 0) for k in range(500, 504)] + [(550, [1.0] * 5, 0), (560, [0.0, 2.0], 0), (561, [0.0, 3.0], 0), (561, [1e-30, 1e30], 0)] + [(k, [k - 560.0, 1.0], 0) for k in range(562, 568)] + [(560, [0.001 * k, 2.0], 0) for k in range(1, 60)]
    data += [(600, None, 0), (650, [0.0] * 8, 0), (700, [1.0] * 7 + [None], 0), (750, [1.0] * 7 + [float("nan")], 0), (800, [1.0] * 7 + [float("inf")], 0), (850, [], 0), (None, data[1][1], 0)]
    df = spark.createDataFrame(data, KIND).repartition(5).withColumns({c: F.lit("x") for c in ("id", "part", "block", "rank", "score", "ids", "n")})
    router = neighbours.fit(df)
    router.cover = 2.0
    same(collected(neighbours.nearest(df, df.where("vec_id % 10 = 0"), router)), want(data, lambda k: k % 10 == 0))


def test_double_components(spark):
    """Doubles stay doubles, and large and small ones do not overflow."""
    data = [(0, [1e200, 1e200]), (1, [1e-200, 2e-200]), (2, [1.0, 1.0 + 1e-12]), (3, [-1e300, 0.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = collected(neighbours.nearest(df, df.where("vec_id = 0"), neighbours.fit(df)))
    assert [k for k, _ in got[0]] == [2, 1, 3] and abs(got[0][1][1] - 3 / math.sqrt(10)) < 1e-12 and abs(got[0][2][1] + math.sqrt(0.5)) < 1e-12


def test_short_queries_search_everywhere(spark):
    """A router that sends each query to one part of few rows: the rest is found all the same."""
    r = np.random.default_rng(9)
    data = [(k, r.normal(size=4).tolist(), 0) for k in range(40)]
    df = spark.createDataFrame(data, KIND)
    far = np.zeros((4, 40))
    router = neighbours.Router(4, [np.eye(4), np.zeros(4), r.normal(size=(4, 40)) + far, np.zeros(40)], cover=0.0)
    got = collected(neighbours.nearest(df, df.where("vec_id < 9"), router))
    assert len(got) == 9 and all(len(v) == 5 for v in got.values())
    few = df.where("vec_id < 3")
    assert {k: len(v) for k, v in collected(neighbours.nearest(few, few, neighbours.fit(few))).items()} == {0: 2, 1: 2, 2: 2}


def test_nothing(spark):
    none = spark.createDataFrame([(1, None, 0), (50, [0.0], 0)], KIND)
    for df in (none, none.limit(0)):
        assert neighbours.fit(df) is None and neighbours.nearest(df, df, None).count() == 0
    one = spark.createDataFrame([(50, [1.0], 0)], KIND)
    assert neighbours.nearest(one, one, neighbours.fit(one)).count() == 0


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.1"])
@pytest.mark.skipif(not oracle.available(), reason="the driver's tables are not here")
def test_recall_of_the_query(spark, sf):
    data = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got, exact = collected(queries.QUERIES["op11_neighbours"](spark, sf)), want(data, lambda k: k % 50 == 0)
    by = {k: np.asarray(v, dtype=np.float64) for k, v in data}
    assert all(abs(s - cosine(by[q], by[k])) < 1e-12 for q, v in got.items() for k, s in v)
    assert got.keys() == exact.keys() and all(len(got[q]) == len(exact[q]) for q in exact)
    found = [k in {x[0] for x in got[q]} for q, v in exact.items() for k, _ in v]
    assert np.mean(found) >= 0.9
