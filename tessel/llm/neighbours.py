"""Approximate nearest neighbours by learned partitions.

A bounded sample of distinct vectors gives a neighbour graph, which is cut into balanced parts with few edges between them. A
small network with one hidden layer learns from a vector which parts its neighbours lie in. It names the part of every row, and
routes a query to its most probable parts, whose rows are compared exactly. How much probability a query must cover is set on
vectors that the network has not seen, so that the share of neighbours found there reaches the recall asked for.

Comparison is a grid of blocks: within a part, rows and queries are packed into blocks and dealt out over a grid of keys, so
that neither a part that holds most rows nor one that most queries go to lands in one task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, draw, large_batches, saved, shared_dir, small_batches

#: Distinct vectors that the graph and the network are fitted on, at most; neighbours of each in the graph.
SAMPLE, DEGREE = 8192, 10
#: Most parts, and the sampled vectors that each has at least; how much larger than the mean a part of the graph may be.
PARTS, LEAST, SLACK = 32, 64, 1.05
#: Share of neighbours that routing must find among sampled vectors the network has not seen.
RECALL = 0.96
HIDDEN, EPOCHS = 128, 30
#: Rows and queries of a block; blocks of each kind that one key of the grid holds, about.
ROWS, ASKED, GRID = 2048, 512, 32
#: Scores of matrix products closer than this are compared again in a fixed order of additions.
CLOSE = 1e-9


# ---- fitting


def units(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in double precision. Scaling by a power of two first keeps squares from overflowing."""
    x = scaled(x)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two of their own, so that the largest component is from 0.5 to 1: no cosine changes."""
    x = x.astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def neighbour_graph(u: np.ndarray, degree: int, block: int = 1024) -> np.ndarray:
    """(n, degree): the nearest other rows of each row, in blocks of the product; fewer columns if there are fewer rows."""
    degree, out = min(degree, len(u) - 1), []
    for a in range(0, len(u), block):
        s = u[a : a + block] @ u.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        best = np.argpartition(-s, degree - 1, axis=1)[:, :degree]
        out.append(np.take_along_axis(best, np.argsort(-np.take_along_axis(s, best, 1), axis=1, kind="stable"), 1))
    return np.concatenate(out)


def balanced_parts(graph: np.ndarray, parts: int, slack: float = SLACK, rounds: int = 40, seed: int = 1) -> np.ndarray:
    """The part of each node, none above slack * n / parts nodes. Parts start as runs of a breadth-first order; then nodes move,
    those with the largest gain in kept edges first, to parts with room, or change places with nodes that want the reverse."""
    n, r = len(graph), np.random.default_rng(seed)
    order, seen = [], np.zeros(n, dtype=bool)
    for start in r.permutation(n):
        front = np.array([start]) if not seen[start] else np.array([], dtype=int)
        while len(front):
            seen[front] = True
            order.append(front)
            front = np.unique(graph[front].ravel())
            front = front[~seen[front]]
    part = np.empty(n, dtype=np.int64)
    part[np.concatenate(order)] = np.arange(n) * parts // n
    ends = np.concatenate([np.stack([np.repeat(np.arange(n), graph.shape[1]), graph.ravel()], 1), np.stack([graph.ravel(), np.repeat(np.arange(n), graph.shape[1])], 1)])
    room = max(int(slack * n / parts), -(-n // parts))
    for _ in range(rounds):
        votes = np.zeros((n, parts), dtype=np.int32)
        np.add.at(votes, (ends[:, 0], part[ends[:, 1]]), 1)
        to = votes.argmax(axis=1)
        gain = votes[np.arange(n), to] - votes[np.arange(n), part]
        want = np.flatnonzero((gain > 0) & (r.random(n) < 0.5))  # not all at once: neighbours would only change places
        want = want[np.argsort(-gain[want], kind="stable")]
        free = room - np.bincount(part, minlength=parts)
        swaps = np.zeros((parts, parts), dtype=np.int64)
        np.add.at(swaps, (part[want], to[want]), 1)
        swaps = np.minimum(swaps, swaps.T)
        for k in want:
            a, b = part[k], to[k]
            if swaps[a, b] > 0:
                swaps[a, b] -= 1
            elif free[b] > 0:
                free[b] -= 1
                free[a] += 1
            else:
                continue
            part[k] = b
    return part


@dataclass
class Router:
    """A network from unit vectors to probabilities of parts, and how much of the probability a query must cover."""

    width: int
    weights: list[np.ndarray]
    cover: float = 1.0

    def probabilities(self, u: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        z = np.maximum(u @ w1 + b1, 0) @ w2 + b2
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def parts_of(self, x: np.ndarray) -> np.ndarray:
        """The most probable part; vectors of another width have a part of their own for each width."""
        if x.shape[1] != self.width:
            return np.full(len(x), -x.shape[1])
        return self.probabilities(units(x)).argmax(axis=1)

    def probes(self, x: np.ndarray) -> list[np.ndarray]:
        """The most probable parts of each query, so many that those before the last have less than `cover`."""
        if x.shape[1] != self.width:
            return [np.array([-x.shape[1]])] * len(x)
        p = self.probabilities(units(x))
        order = np.argsort(-p, axis=1, kind="stable")
        p = np.take_along_axis(p, order, 1)
        return [o[: max(1, k)] for o, k in zip(order, ((np.cumsum(p, axis=1) - p) < self.cover).sum(axis=1))]


def learn(u: np.ndarray, aims: np.ndarray, hidden: int = HIDDEN, epochs: int = EPOCHS, seed: int = 1) -> list[np.ndarray]:
    """Weights that bring the network's probabilities near the rows of `aims`, by Adam on the cross entropy."""
    r, (n, width), parts = np.random.default_rng(seed), u.shape, aims.shape[1]
    w = [r.normal(0, (2 / width) ** 0.5, (width, hidden)), np.zeros(hidden), r.normal(0, hidden**-0.5, (hidden, parts)), np.zeros(parts)]
    m, v, t = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w], 0
    for epoch in range(epochs):
        order = r.permutation(n)
        for a in range(0, n, 256):
            x, y = u[order[a : a + 256]], aims[order[a : a + 256]]
            h = np.maximum(x @ w[0] + w[1], 0)
            z = h @ w[2] + w[3]
            e = np.exp(z - z.max(axis=1, keepdims=True))
            d = (e / e.sum(axis=1, keepdims=True) - y) / len(x)
            dh = (d @ w[2].T) * (h > 0)
            t += 1
            for k, g in enumerate((x.T @ dh, dh.sum(0), h.T @ d, d.sum(0))):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w[k] = w[k] - 3e-3 * (1 - epoch / epochs) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return w


def route_sample(x: np.ndarray, parts: int = PARTS, recall: float = RECALL, degree: int = DEGREE, top: int = 5) -> Router:
    """A router fitted on the rows of x. Every fifth row is held out of the network's training, for `cover`."""
    u = units(x)
    parts = max(1, min(parts, len(u) // LEAST))
    if parts == 1:
        return Router(x.shape[1], [np.zeros((x.shape[1], 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)])
    graph = neighbour_graph(u, degree)
    part = balanced_parts(graph, parts)
    aims = np.zeros((len(u), parts))
    np.add.at(aims, (np.repeat(np.arange(len(u)), graph.shape[1]), part[graph].ravel()), 1)
    aims[np.arange(len(u)), part] += 1
    aims /= aims.sum(axis=1, keepdims=True)
    held = np.arange(len(u)) % 5 == 0
    router = Router(x.shape[1], learn(u[~held], aims[~held]))
    p = router.probabilities(u)
    before = np.cumsum(np.sort(p[held], axis=1)[:, ::-1], axis=1)
    place = np.argsort(np.argsort(-p[held], axis=1, kind="stable"), axis=1)
    at = np.take_along_axis(place, p.argmax(axis=1)[graph[held][:, :top]], 1)
    mass = np.where(at > 0, np.take_along_axis(before, np.maximum(at - 1, 0), 1), 0.0)
    router.cover = float(np.quantile(mass, recall, method="higher")) + 1e-12
    return router


def usable(c: str) -> Column:
    """Not null, some component not zero, and no component null or not finite."""
    size = lambda x: F.abs(x.cast("double"))
    return F.coalesce(F.forall(c, lambda x: size(x) < float("inf")) & F.exists(c, lambda x: size(x) > 0), F.lit(False))


def fit(vectors: DataFrame, sample: int = SAMPLE, parts: int = PARTS, recall: float = RECALL, embedding: str = "embedding") -> Router | None:
    """A router fitted on at most about `sample` distinct vectors of the most frequent width in the sample, drawn by their hash
    over the whole table. None if no vector is usable."""
    have = vectors.where(usable(embedding)).select(F.col(embedding).alias("v"))
    n = have.agg(F.approx_count_distinct(F.xxhash64("v"), 0.02)).first()[0]
    rows = [r.v for r in have.where(draw("route", "v") < F.lit(sample / max(n, 1))).distinct().collect()]
    if not rows:
        return None
    widths = [len(v) for v in rows]
    width = max(set(widths), key=lambda k: (widths.count(k), -k))
    return route_sample(np.array(sorted(v for v in rows if len(v) == width), dtype=np.float64), parts, recall)


# ---- rows and queries, packed


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) of the vectors of each width in a batch with the column `embedding`."""
    column = batch.column(batch.schema.get_field_index("embedding"))
    widths, flat = column.value_lengths().to_numpy(), column.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(widths) - widths
    for width in np.unique(widths):
        at = np.flatnonzero(widths == width)
        yield at, flat[starts[at][:, None] + np.arange(width)]


def index(vectors: DataFrame, router: Router, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(id, embedding, part) of every usable row with an id."""
    rows = vectors.where(F.col(key).isNotNull() & usable(embedding)).select(F.col(key).cast("long").alias("id"), F.col(embedding).alias("embedding"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = np.zeros(batch.num_rows, dtype=np.int32)
            for at, x in _matrices(batch):
                part[at] = router.parts_of(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part)], ["id", "embedding", "part"])

    return rows.mapInArrow(run, f"id long, embedding {rows.schema['embedding'].dataType.simpleString()}, part int")


def routed(questions: DataFrame, router: Router) -> DataFrame:
    """(id, embedding, part) for each part that a question (id, embedding) goes to."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            probes: list[list[int]] = [[]] * batch.num_rows
            for at, x in _matrices(batch):
                for k, own in zip(at, router.probes(x)):
                    probes[k] = own.tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(probes, pa.list_(pa.int32()))], ["id", "embedding", "parts"])

    kind = questions.schema["embedding"].dataType.simpleString()
    return questions.mapInArrow(run, f"id long, embedding {kind}, parts array<int>").select("id", "embedding", F.explode("parts").alias("part"))


def _packed(rows: DataFrame, sizes: dict[int, int], most: int) -> DataFrame:
    """(part, block, n, ids, vectors): blocks of up to `most` rows (id, embedding, part), as bytes of whole numbers and of the
    vectors' own type.

    A part of many rows is dealt out, by its rows' places in the table, over as many tasks as it has `GRID` blocks; `block` is
    a hash that spreads the blocks of a part."""
    deals = F.element_at(F.create_map(*[F.lit(x) for p, n in sizes.items() for x in (p, n // (GRID * most) + 1)]), F.col("part"))
    kind = _kind(rows)
    dealt = rows.withColumn("deal", F.pmod(F.monotonically_increasing_id(), deals).cast("int"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ids, vectors, n, made = None, [], [], 0, 0

        def block() -> pa.RecordBatch:
            nonlocal ids, vectors, n, made
            made += 1
            one = [pa.array([part], pa.int32()), pa.array([made], pa.int32()), pa.array([n], pa.int32()), pa.array([np.concatenate(ids).tobytes()], pa.binary()), pa.array([np.concatenate(vectors).tobytes()], pa.binary())]
            ids, vectors, n = [], [], 0
            return pa.RecordBatch.from_arrays(one, ["part", "made", "n", "ids", "vectors"])

        for batch in batches:
            parts, keys = batch.column(2).to_numpy(), batch.column(0).to_numpy()
            for at, x in sorted(_matrices(batch), key=lambda m: parts[m[0][0]]):  # a part has one width
                for own in np.split(at, np.flatnonzero(np.diff(parts[at])) + 1):
                    if parts[own[0]] != part and n:
                        yield block()
                    part, rest = parts[own[0]], x[np.searchsorted(at, own)].astype(kind)
                    own = keys[own]
                    while len(own):
                        room = most - n
                        ids.append(own[:room])
                        vectors.append(rest[:room])
                        n += len(own[:room])
                        own, rest = own[room:], rest[room:]
                        if n == most:
                            yield block()
        if n:
            yield block()

    out = dealt.repartition("part", "deal").sortWithinPartitions("part").select("id", "embedding", "part").mapInArrow(run, "part int, made int, n int, ids binary, vectors binary")
    return out.withColumn("block", F.xxhash64("part", "made", "ids")).drop("made")


def _kind(rows: DataFrame) -> str:
    """The numpy type that holds a table's vectors without loss: floats stay floats, all others become doubles."""
    return "f4" if rows.schema["embedding"].dataType.simpleString() == "array<float>" else "f8"


def _compared(top_k: int, kind: str, q_kind: str):
    """Pairs of a block of rows and one of queries -> (query_id, vec_id, score, which: a hash of the vector): the top_k
    of each query within the pair."""

    def pair(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, ...]:
        q, x = scaled(q), scaled(x)
        q_norms, norms = np.sqrt((q * q).sum(axis=1)), np.sqrt((x * x).sum(axis=1))
        order = np.lexsort((ids, *x.T))
        ids, x, norms = ids[order], x[order], norms[order]
        new = np.concatenate([[True], (x[1:] != x[:-1]).any(axis=1)])
        same = np.cumsum(new) - 1
        again = np.concatenate([[False], (ids[1:] == ids[:-1]) & ~new[1:]])
        place = np.arange(len(ids)) - np.flatnonzero(new)[same] - (np.cumsum(again) - np.cumsum(again)[np.flatnonzero(new)][same])
        held = np.flatnonzero(~again & (place <= top_k))  # of equal vectors only the smallest ids can come up
        s = (q @ x[new].T) / q_norms[:, None] / norms[new]
        by_id = np.argsort(q_ids, kind="stable")
        at = np.searchsorted(q_ids, ids[held], sorter=by_id)
        own = np.flatnonzero((at < len(q_ids)) & (q_ids[by_id[np.minimum(at, len(q_ids) - 1)]] == ids[held]))
        own = own[np.bincount(same[held])[same[held[own]]] == 1]
        s[by_id[at[own]], same[held[own]]] = -np.inf  # vectors that only the query's own id has
        keep = min(top_k, s.shape[1])
        least = np.partition(s, s.shape[1] - keep, axis=1)[:, s.shape[1] - keep] - CLOSE
        group_starts, group_sizes = np.searchsorted(same[held], np.arange(s.shape[1])), np.bincount(same[held], minlength=s.shape[1])
        a, g = np.nonzero(s >= least[:, None])
        reps = group_sizes[g]
        a, c = np.repeat(a, reps), held[np.repeat(group_starts[g], reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)]
        other = q_ids[a] != ids[c]
        a, c = a[other], c[other]
        score = (q[a] * x[c]).sum(axis=1) / (q_norms[a] * norms[c])
        best = np.lexsort((ids[c], -score, a))
        a, c, score = a[best], c[best], score[best]
        first = np.searchsorted(a, a)
        top = np.arange(len(a)) - first < top_k
        a, c = a[top], c[top]
        return q_ids[a], ids[c], score[top], np.array([xxhash.xxh64_intdigest(v.tobytes()) for v in x[c]], dtype=np.uint64).view(np.int64)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, q_ids = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["q_ids"], np.int64)
                found = pair(q_ids, np.frombuffer(row["q_vectors"], q_kind).reshape(len(q_ids), -1), ids, np.frombuffer(row["vectors"], kind).reshape(len(ids), -1))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["query_id", "vec_id", "score", "which"])

    return run


def _search(rows: DataFrame, asked: DataFrame, top_k: int, folder: str, name: str) -> DataFrame:
    """(query_id, rank, vec_id, score) of queries (id, embedding, part) among rows (id, embedding, part)."""
    spark = rows.sparkSession
    sizes, askers = ({r["part"]: r["count"] for r in df.groupBy("part").count().collect()} for df in (rows, asked))  # a row a part
    sizes, askers = ({p: n for p, n in x.items() if p in y} for x, y in ((sizes, askers), (askers, sizes)))
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    large_batches(spark)
    both = F.col("part").isin(list(sizes))
    left = saved(_packed(rows.where(both), sizes, ROWS), folder, f"{name}-rows")
    right = saved(_packed(asked.where(both), askers, ASKED), folder, f"{name}-asked")
    small_batches(spark)

    def cells(of: dict[int, int], most: int) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for p, n in of.items() for x in (p, n // (GRID * most) + 1)]), F.col("part"))

    left = left.select("part", "ids", "vectors", F.pmod("block", cells(sizes, ROWS)).alias("x"), F.explode(F.sequence(F.lit(0), cells(askers, ASKED) - 1)).alias("y"))
    right = right.select("part", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), F.pmod("block", cells(askers, ASKED)).alias("y"), F.explode(F.sequence(F.lit(0), cells(sizes, ROWS) - 1)).alias("x"))
    pairs = left.join(right.hint("shuffle_hash"), ["part", "x", "y"]).select("ids", "vectors", "q_ids", "q_vectors")
    found = pairs.mapInArrow(_compared(top_k, _kind(rows), _kind(asked)), "query_id long, vec_id long, score double, which long").distinct()
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")
    return saved(found.withColumn("rank", best).where(F.col("rank") <= top_k).select("query_id", "rank", "vec_id", "score"), folder, f"{name}-found")


def nearest(vectors: DataFrame, questions: DataFrame, router: Router | None, top_k: int = 5, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest rows of `vectors` to each row of `questions` by cosine, in double precision,
    ties to the smaller id; rows of the query's own id are not candidates.

    Routing finds most of them (see RECALL); of the rows it reaches none is left out. A query that reaches fewer than top_k is
    searched again over all parts of its width, and has fewer rows only if there are fewer candidates. Rows without an id, and
    vectors that are null, empty or zero or hold a null, a NaN or an infinity take no part, neither as rows nor as queries.
    Equal rows (id and vector) are one candidate; rows of one id and different vectors are different ones, and a query is the
    smallest of the vectors of its id. Vectors meet only those of their own width. Columns of other names are not read. Empty tables
    give an empty result."""
    spark = vectors.sparkSession
    if router is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    folder = shared_dir(spark)
    large_batches(spark)
    rows = saved(index(vectors, router, key, embedding), folder, "index")
    asked = questions.where(F.col(key).isNotNull() & usable(embedding)).groupBy(F.col(key).cast("long").alias("id")).agg(F.min(embedding).alias("embedding"))
    asked = saved(routed(asked, router), folder, "asked")
    found = _search(rows, asked, top_k, folder, "near")
    full = found.where(F.col("rank") == top_k).select(F.col("query_id").alias("id"))
    short = saved(asked.groupBy("id").agg(F.first("embedding").alias("embedding")).join(full, "id", "left_anti"), folder, "short")
    if not short.isEmpty():
        parts = rows.groupBy(F.size("embedding").alias("w"), "part").count().groupBy("w").agg(F.collect_list("part").alias("parts"))
        everywhere = short.join(parts, F.size("embedding") == F.col("w")).select("id", "embedding", F.explode("parts").alias("part"))
        rest = _search(rows, everywhere, top_k, folder, "rest")
        found = found.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(rest)
    for old in ("index", "asked", "near-rows", "near-asked", "rest-rows", "rest-asked"):
        discard(spark, f"{folder}/{old}")
    return found


def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0), fit(vectors))
