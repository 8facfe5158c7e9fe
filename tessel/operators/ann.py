"""Approximate vector search: lists by nearest centroid (inverted file), probed by each query, with an exact way out."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.functions.text import bound
from tessel.functions.vector import constant, dot, norm
from tessel.operators.retrieval import Block, _keep_best, _renamed, _units, as_queries, blocks, ranked, vector_search
from tessel.tables import sampled, saved, shared_dir

#: Vectors that centroids are fitted on, about; rows below which a table is searched as it is.
SAMPLE, LEAST = 20_000, 5_000


def _unit(embedding: str):
    return bound(norm(embedding), lambda n: F.when(n > 0, F.transform(embedding, lambda x: x.cast("double") / n)))


def fit(chunks: DataFrame, lists: int, embedding: str = "embedding", key: str = "id", sample: int = SAMPLE, seed: int = 1) -> list[list[float]]:
    """Centroids of unit vectors, fitted on about `sample` rows by a hash of their key."""
    have = chunks.where(F.size(embedding) > 0)
    have = sampled(have, have.count(), sample, seed, key)
    unit = saved(have.select(_unit(embedding).alias("u")).where("u is not null"), shared_dir(chunks.sparkSession), "sample")  # read by every round of the fit
    model = KMeans(k=lists, seed=seed, featuresCol="v", maxIter=15).fit(unit.select(array_to_vector("u").alias("v")))
    return [list(map(float, c)) for c in model.clusterCenters()]


def assign(chunks: DataFrame, centroids: Sequence[Sequence[float]], embedding: str = "embedding") -> DataFrame:
    """Adds the list of every row with a vector: its nearest centroid. Write it partitioned by `list` to have probes prune."""
    c = np.array(centroids, dtype=np.float64)

    @F.pandas_udf("int")
    def nearest(vectors: pd.Series) -> pd.Series:
        out = np.zeros(len(vectors), dtype=np.int32)  # vectors without direction, or of another width, are in the first list
        own = np.array([k for k, v in enumerate(vectors) if v is not None and len(v) == c.shape[1]], dtype=np.int64)
        if own.size:
            far = (c**2).sum(axis=1) / 2 - _units(np.array([vectors[k] for k in own], dtype=np.float64)) @ c.T
            good = ~np.isnan(far).any(axis=1)
            out[own[good]] = far[good].argmin(axis=1)
        return pd.Series(out)

    return chunks.where(F.size(embedding) > 0).withColumn("list", nearest(embedding))


def probed(block: Block, centroids: np.ndarray, probes: int) -> np.ndarray:
    """(lists, queries): which lists each query of a block looks into, its nearest ones."""
    out = np.zeros((len(centroids), len(block.ids)), dtype=bool)
    for width, own in block.by_width.items():
        if width == centroids.shape[1]:
            unit = np.nan_to_num(block.units[width])
            far = (centroids**2).sum(axis=1)[:, None] - 2 * centroids @ unit.T
            near = np.argsort(far, axis=0, kind="stable")[:probes]
            out[near, np.array(own)[None, :]] = True
    return out


def search(assigned: DataFrame, centroids: Sequence[Sequence[float]], vectors: Sequence[Sequence[float]] | DataFrame, top_k: int, probes: int = 8, key: str = "id", embedding: str = "embedding", least: int = LEAST) -> DataFrame:
    """(query, key, score, rank): each query (of a list, or of a table (query, embedding)) looks only into its own lists. A
    query whose lists hold fewer than top_k rows is searched over all rows, and so is every query where the table has fewer
    than `least` rows. Rows that `changed` has marked as dead take no part."""
    spark, assigned = assigned.sparkSession, live(assigned)
    queries = as_queries(spark, vectors)
    # written once: rows are assigned once, and every block of queries reads them
    have = assigned = saved(assigned.where(F.size(embedding) > 0).select(key, embedding, "list"), shared_dir(spark), "assigned")
    sizes = np.zeros(len(centroids), dtype=np.int64)
    for r in assigned.groupBy("list").count().collect():  # a row for each list
        sizes[r["list"]] = r["count"]
    if sizes.sum() < least:
        return vector_search(assigned, queries, top_k, key, embedding)
    c, found, short = np.array(centroids), [], []
    kinds = f"query {queries.schema['query'].dataType.simpleString()}, `{key}` {have.schema[key].dataType.simpleString()}, score double"
    for block in blocks(queries):
        mask = probed(block, c, probes)
        few = sizes @ mask < top_k
        short += [block.ids[k] for k in np.flatnonzero(few)]
        mask[:, few] = False
        shared = spark.sparkContext.broadcast((block, mask))
        wanted = np.flatnonzero(mask.any(axis=1)).tolist()
        found.append(have.where(F.col("list").isin(wanted)).mapInArrow(lambda batches, s=shared: _renamed(_probe(*s.value, top_k, batches), ["query", key, "score"]), kinds))
    out = reduce(DataFrame.unionByName, found) if found else have.where(F.lit(False)).select(F.lit(0).alias("query"), key, F.lit(0.0).alias("score"))
    out = ranked(out, ["query"], top_k, key)
    if short:
        rest = queries.join(spark.createDataFrame([(x,) for x in short], f"query {queries.schema['query'].dataType.simpleString()}"), "query", "left_semi")
        out = out.unionByName(vector_search(assigned, rest, top_k, key, embedding))
    return out


def _probe(block: Block, mask: np.ndarray, top_k: int, batches):
    return _keep_best(block, top_k, batches, mask)


#: A list is rebuilt when it has more than so many times the mean of live rows, or more than this share of its rows are dead.
GROWN, DEAD = 2.0, 0.3


def changed(assigned: DataFrame, centroids: Sequence[Sequence[float]], upserts: DataFrame, deletes: DataFrame, key: str = "id", embedding: str = "embedding") -> DataFrame:
    """Lists after a write, with no fit: rows that are replaced or deleted are marked (live = false), new ones join the list of the nearest centroid.

    Of several upserts of one key the greatest row by its columns counts; a key that is both upserted and deleted is upserted. Rows that come without
    a vector only mark what was there. The columns are those of `assigned` and live; search() passes over dead rows by `live(...)`."""
    was = assigned if "live" in assigned.columns else assigned.withColumn("live", F.lit(True))
    cols = [c for c in was.columns if c not in ("list", "live")]
    last = upserts.groupBy(key).agg(F.max(F.struct(*[F.col(f"`{c}`") for c in cols if c != key])).alias("__r")).select(*[F.col(f"`{c}`") if c == key else F.col(f"__r.`{c}`").alias(c) for c in cols])
    gone = last.select(key).unionByName(deletes.select(key)).distinct().withColumn("__gone", F.lit(True))
    marked = was.join(gone, key, "left").withColumn("live", F.col("live") & F.col("__gone").isNull()).select(*was.columns)
    return marked.unionByName(assign(last, centroids, embedding).withColumn("live", F.lit(True)).select(*was.columns))


def live(assigned: DataFrame) -> DataFrame:
    return assigned.where("live") if "live" in assigned.columns else assigned


def due(assigned: DataFrame, grown: float = GROWN, dead: float = DEAD) -> DataFrame:
    """(list, rows, dead, split, sweep) of the lists that are to be rebuilt: split if they have grown, swept if much is dead."""
    own = assigned.groupBy("list").agg(F.count_if("live").alias("rows"), F.count_if(~F.col("live")).alias("dead"))
    mean = own.agg(F.avg("rows").alias("mean"))  # one row
    both = own.join(F.broadcast(mean)).select("list", "rows", "dead", (F.col("rows") > grown * F.col("mean")).alias("split"), (F.col("dead") > dead * (F.col("rows") + F.col("dead"))).alias("sweep"))
    return both.where("split or sweep")


def rebuilt(assigned: DataFrame, centroids: Sequence[Sequence[float]], grown: float = GROWN, dead: float = DEAD, embedding: str = "embedding", key: str = "id", sample: int = SAMPLE) -> tuple[DataFrame, list[list[float]]]:
    """(lists, centroids) with the lists that are due rebuilt: dead rows go, and a list that has grown is cut in two by centroids fitted on a
    sample of its own rows alone. One half keeps the list's number, the other takes the next free one; all other lists, and their rows,
    stay as they are, so files partitioned by `list` are rewritten only for these."""
    assigned = saved(assigned, shared_dir(assigned.sparkSession), "lists")
    rows = due(assigned, grown, dead).collect()  # a row for each list
    swept, out = [r["list"] for r in rows], [list(c) for c in centroids]
    if not rows:
        return assigned, out
    kept = assigned.where(F.col("live") | ~F.col("list").isin(swept))
    for r in rows:
        if r["split"]:
            own = kept.where(F.col("list") == r["list"])
            halves = fit(own, 2, embedding, key, sample)
            if len(halves) < 2:  # equal vectors cannot be parted
                continue
            (a, b), unit, here, new = halves, _unit(embedding), r["list"], len(out)
            far = lambda c: float(np.dot(c, c)) / 2 - dot(unit, constant(c))  # noqa: B023, E731
            moved = F.when(F.col("live") & (F.col("list") == here) & (far(b) < far(a)), F.lit(new)).otherwise(F.col("list"))
            kept = kept.withColumn("list", moved.cast("int"))
            out[here] = a
            out.append(b)
    return kept, out
