"""Queries over sequences: a cache of corpora, continuation pages, lanes by size."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessel.operators import caches, lanes, paging
from tessel.plans.registry import query, table


@query("""WITH a AS (SELECT event_type AS cache, event_id AS seq, user_id % 20 AS key, lag(event_id) OVER (PARTITION BY event_type, user_id % 20 ORDER BY event_id) AS prev FROM events),
between_ AS (SELECT a.cache, a.seq, count(DISTINCT b.key) AS n FROM a JOIN a b ON b.cache = a.cache AND b.seq > a.prev AND b.seq < a.seq GROUP BY 1, 2),
upto AS (SELECT a.cache, a.seq, b.key, max(b.seq) AS last FROM a JOIN a b ON b.cache = a.cache AND b.seq < a.seq AND b.key <> a.key GROUP BY 1, 2, 3),
eighth AS (SELECT cache, seq, key FROM upto QUALIFY row_number() OVER (PARTITION BY cache, seq ORDER BY last DESC) = 8)
SELECT cache, seq, a.key, prev IS NOT NULL AND coalesce(n, 0) < 8 AS hit, CASE WHEN prev IS NOT NULL AND coalesce(n, 0) < 8 THEN -1 ELSE coalesce(eighth.key, -1) END AS evicted
FROM a LEFT JOIN between_ USING (cache, seq) LEFT JOIN eighth USING (cache, seq)""")
def corpus_cache(spark, sf_dir):
    """Eight corpora are held for each kind of event; users stand for corpora."""
    accesses = table(spark, sf_dir, "events").select(F.col("event_type").alias("cache"), F.col("event_id").alias("seq"), (F.col("user_id") % 20).alias("key"))
    return caches.replay(accesses).withColumn("evicted", F.coalesce("evicted", F.lit(-1)))


@query("""WITH w AS (SELECT o_custkey AS thread, o_orderkey AS token, o_orderkey % 4 AS n, row_number() OVER o - 1 AS rank, coalesce(sum(o_orderkey % 4) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first
FROM orders WINDOW o AS (PARTITION BY o_custkey ORDER BY o_orderkey)), c AS (SELECT *, unnest(range(n)) AS k FROM w WHERE n > 0)
SELECT thread, token, rank, (first + k)::bigint AS place, chr((97 + k)::int) AS comment FROM c WHERE first + k < 10""")
def comment_pages(spark, sf_dir):
    """Each customer's orders are pages that name the next one; the last names the first again, where the walk ends."""
    own = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("thread"), F.col("o_orderkey").alias("token"), F.lead("o_orderkey").over(own).alias("following"), F.first("o_orderkey").over(own).alias("head"))
    pages = o.select("thread", "token", F.coalesce("following", "head").alias("next"), F.slice(F.array(*map(F.lit, "abc")), F.lit(1), (F.col("token") % 4).cast("int")).alias("comments"))
    return paging.collected(pages.repartition(4), o.where("token = head").select("thread", "token"), 10)


@query("""WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS size FROM documents)
SELECT l AS lanes, (SELECT count(*) FROM d) AS items, (SELECT sum(size)::bigint FROM d) AS size, true AS within FROM (SELECT unnest([3, 16]) AS l)""")
def balanced_lanes(spark, sf_dir):
    """Documents by length over few and over many lanes: the heaviest is within 4/3 of a bound that no division can go below."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("size"))
    least = docs.agg(F.sum("size").alias("all"), F.max("size").alias("largest"))
    out = None
    for n in (3, 16):
        own = lanes.loads(lanes.balanced(docs, n, "doc_id"), n).agg(F.sum("n").alias("items"), F.sum("size").cast("long").alias("size"), F.max("size").alias("heaviest"))
        bound = F.greatest(F.col("all") / n, F.col("largest")) * 4 / 3
        row = own.join(F.broadcast(least)).select(F.lit(n).alias("lanes"), "items", "size", (F.col("heaviest") <= bound).alias("within"))
        out = row if out is None else out.unionByName(row)
    return out
