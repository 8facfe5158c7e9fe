"""Queries of incremental maintenance: reuse, replacement, pruning, states, caches, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessel.operators import feeds, index
from tessel.plans.registry import query, table
from tessel.tables import shared_dir

_ITEMS = "SELECT 'library' AS source_type, source AS source_id, doc_id::varchar AS item_id, doc_id, text AS content FROM documents"


def items(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(F.lit("library").alias("source_type"), F.col("source").alias("source_id"), F.col("doc_id").cast("string").alias("item_id"), F.col("text").alias("content"), F.lit("{}").alias("meta"), "doc_id")


def old_items(spark, sf_dir):
    """What was indexed before: every seventh item is new since, every fifth has changed, and some are gone by now."""
    own = items(spark, sf_dir).where("doc_id % 7 <> 0").withColumn("content", F.when(F.col("doc_id") % 5 == 0, F.concat("content", F.lit(" old"))).otherwise(F.col("content")))
    gone = items(spark, sf_dir).where("doc_id % 11 = 0").withColumn("item_id", F.concat(F.lit("gone-"), "item_id"))
    return own.unionByName(gone)


_OLD = f"""old AS (
  SELECT source_type, source_id, item_id, doc_id, CASE WHEN doc_id % 5 = 0 THEN content || ' old' ELSE content END AS content FROM items WHERE doc_id % 7 <> 0
  UNION ALL SELECT source_type, source_id, 'gone-' || item_id, doc_id, content FROM items WHERE doc_id % 11 = 0
)"""
_WINDOWS = r"""CASE WHEN len(w) = 0 THEN [] WHEN len(w) <= 512 THEN [0] ELSE range(0, ceil((len(w) - 512) / 448.0)::int + 1) END"""


def _chunks_sql(name: str) -> str:
    return rf"""{name}_chunks AS (
  SELECT source_type, source_id, item_id, source_type || ':' || source_id || ':' || item_id || ':' || k AS id, k AS chunk_index, array_to_string(w[k * 448 + 1 : k * 448 + 512], ' ') AS content
  FROM (SELECT *, unnest({_WINDOWS})::int AS k FROM (SELECT *, list_filter(regexp_split_to_array(content, '\s+'), lambda x: x <> '') AS w FROM {name}))
)"""


def pseudo_embed(missing):
    """A deterministic stand-in for a model: four numbers from the hash; texts that contain `scum` fail."""
    v = F.array(*[(F.conv(F.substring("embed_hash", 1 + 4 * k, 4), 16, 10).cast("float") / 65535.0).cast("float") for k in range(4)])
    return missing.select("embed_hash", F.when(~F.col("content").contains("scum"), v).alias("embedding"))


def _store(spark, sf_dir):
    own = index.chunk_items(old_items(spark, sf_dir))
    return own.join(pseudo_embed(own.groupBy("embed_hash").agg(F.min("content").alias("content"))), "embed_hash").withColumn("model", F.lit("m"))


@query(f"WITH items AS ({_ITEMS}), {_chunks_sql('items')} SELECT sha1(content) AS embed_hash, min(id) AS id, count(*) AS n FROM items_chunks GROUP BY 1")
def cached_vectors(spark, sf_dir):
    own = index.chunk_items(items(spark, sf_dir).drop("doc_id")).withColumn("embedding", F.array(F.lit(1.0).cast("float"))).withColumn("model", F.lit("m"))
    one = index.cached_vectors(own, "m").select("embed_hash")
    return own.join(one, "embed_hash").groupBy("embed_hash").agg(F.min("id").alias("id"), F.count("*").alias("n"))


@query(f"""WITH items AS ({_ITEMS}), {_OLD}, {_chunks_sql('items')}, {_chunks_sql('old')},
known AS (SELECT DISTINCT sha1(content) AS h FROM old_chunks WHERE NOT contains(content, 'scum'))
SELECT source_type, source_id, count(*) AS chunks, count(h) AS reused, sum((h IS NULL AND NOT contains(content, 'scum'))::int)::bigint AS embedded,
       sum(contains(content, 'scum')::int)::bigint AS failed
FROM items_chunks LEFT JOIN known ON h = sha1(content) GROUP BY ALL""")
def upsert_reuse(spark, sf_dir):
    out = index.with_vectors(index.chunk_items(items(spark, sf_dir).drop("doc_id")), _store(spark, sf_dir), pseudo_embed, "m")
    return out.groupBy("source_type", "source_id").agg(F.count("*").alias("chunks"), F.count_if("reused").alias("reused"), F.count_if(~F.col("reused") & F.col("embedding").isNotNull()).alias("embedded"), F.count_if(F.col("embedding").isNull()).alias("failed"))


@query(f"""WITH items AS ({_ITEMS}), {_OLD}, {_chunks_sql('items')}, {_chunks_sql('old')}
SELECT id, sha1(content) AS content_hash FROM items_chunks WHERE item_id::bigint % 3 = 0
UNION ALL SELECT id, sha1(content) FROM old_chunks WHERE starts_with(item_id, 'gone') OR item_id::varchar NOT IN (SELECT item_id FROM items WHERE doc_id % 3 = 0)""")
def upsert_replace(spark, sf_dir):
    todo = items(spark, sf_dir).where("doc_id % 3 = 0").drop("doc_id")
    stored = index.chunk_items(old_items(spark, sf_dir).drop("doc_id"))
    return index.replace_items(stored, todo, index.chunk_items(todo)).select("id", "content_hash")


@query(f"""WITH items AS ({_ITEMS}), {_OLD}, {_chunks_sql('old')}
SELECT id FROM old_chunks WHERE source_id <> 'src1' OR item_id IN (SELECT item_id FROM items WHERE doc_id % 2 = 1)""")
def prune(spark, sf_dir):
    keep = items(spark, sf_dir).where("doc_id % 2 = 1").select("item_id")
    return index.prune(index.chunk_items(old_items(spark, sf_dir)), "library", "src1", keep).select("id")


@query(f"WITH items AS ({_ITEMS}), {_OLD}, {_chunks_sql('old')} SELECT source_id, count(*) AS n FROM old_chunks WHERE source_id <> 'src2' GROUP BY 1")
def delete_source(spark, sf_dir):
    return index.delete_source(index.chunk_items(old_items(spark, sf_dir)), "src2").groupBy("source_id").agg(F.count("*").alias("n"))


@query(f"""WITH items AS ({_ITEMS}), {_OLD},
both_sides AS (SELECT coalesce(i.source_type, o.source_type) AS source_type, coalesce(i.source_id, o.source_id) AS source_id, sha1(i.content) AS now, sha1(o.content) AS then_, CASE WHEN o.source_id IN ('src1', 'src4') THEN 'before' WHEN o.source_id IS NOT NULL THEN 'now' END AS signed
         FROM items i FULL JOIN old o ON i.source_type = o.source_type AND i.source_id = o.source_id AND i.item_id = o.item_id),
counts AS (SELECT source_type, source_id, count(*) FILTER (then_ IS NULL) AS added, count(*) FILTER (now IS NULL) AS removed, count(*) FILTER (now <> then_) AS changed, count(*) FILTER (signed <> 'now') AS resigned, count(then_) AS known FROM both_sides GROUP BY ALL)
SELECT source_type, source_id, added, removed, changed, resigned, CASE WHEN known = 0 THEN 'none' WHEN added + removed + changed + resigned > 0 THEN 'stale' ELSE 'compiled' END AS state FROM counts""")
def stale_state(spark, sf_dir):
    """Two sources were compiled with another model."""
    sig = index.signature("m")
    old = old_items(spark, sf_dir).withColumns({"fingerprint": F.sha1("content"), "signature": F.when(F.col("source_id").isin("src1", "src4"), index.signature("before")).otherwise(sig)})
    return index.state(items(spark, sf_dir), old, sig)


@query(f"""WITH items AS ({_ITEMS}), {_chunks_sql('items')}
SELECT source_type, source_id, item_id, count(*) AS chunks, sum(contains(content, 'scum')::int)::bigint AS failed, sum(contains(content, 'scum')::int) = 0 AS complete FROM items_chunks GROUP BY ALL""")
def completeness(spark, sf_dir):
    own = index.chunk_items(items(spark, sf_dir)).withColumn("embedding", F.when(~F.col("content").contains("scum"), F.array(F.lit(1.0))))
    return index.completeness(own)


@query(f"""WITH items AS ({_ITEMS}), {_OLD}, {_chunks_sql('items')}
SELECT 'store' AS part, id AS key FROM items_chunks
UNION ALL SELECT 'manifest', i.item_id FROM items i WHERE
  EXISTS (SELECT 1 FROM old o WHERE o.item_id = i.item_id AND o.source_id = i.source_id AND o.content = i.content AND length(trim(o.content)) > 0 AND o.source_id <> 'src1')
  OR EXISTS (SELECT 1 FROM items_chunks c WHERE c.item_id = i.item_id GROUP BY c.item_id HAVING NOT bool_or(contains(c.content, 'scum')))""")
def compile_library(spark, sf_dir):
    """The whole compile: unchanged items skipped, the others replaced, vanished ones pruned, complete ones listed."""
    kept = index.ChunkStore(spark, shared_dir(spark), buckets=8)
    kept.write(_store(spark, sf_dir).drop("doc_id"))
    stored = kept.read()
    old = old_items(spark, sf_dir).select("source_type", "source_id", "item_id", F.sha1("content").alias("fingerprint"), F.when(F.col("source_id") == "src1", "of another model").otherwise(index.signature("m")).alias("signature"), F.lit(1).cast("long").alias("chunks"))
    store, listed = index.compile_items(items(spark, sf_dir).drop("doc_id"), stored, old, pseudo_embed, "m")
    return store.select(F.lit("store").alias("part"), F.col("id").alias("key")).unionByName(listed.select(F.lit("manifest").alias("part"), F.col("item_id").alias("key")))


def _cached(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("k", F.col("doc_id") % 6)
    entry = lambda text, source, url: d.select(F.col("doc_id").alias("id"), "k", text.alias("transcript"), source.alias("source"), url.alias("url"))
    old = entry(F.col("text"), F.when(F.col("k") < 3, "asr").otherwise("published"), F.concat(F.lit("u"), F.col("k"))).where("id % 4 <> 0")
    new = entry(F.when(F.col("k") == 5, F.lit("")).otherwise(F.when(F.col("k") % 2 == 0, F.concat("text", F.lit(" and more"))).otherwise(F.expr("substr(text, 2)"))), F.when(F.col("k").isin(0, 4), "published").otherwise("asr"), F.concat(F.lit("u"), F.col("k") % 4)).where("id % 9 <> 0")
    return old.drop("k"), new.drop("k")


@query(r"""WITH d AS (SELECT doc_id, doc_id % 6 AS k, text FROM documents),
o AS (SELECT doc_id AS id, text AS transcript, CASE WHEN k < 3 THEN 'asr' ELSE 'published' END AS source, 'u' || k AS url FROM d WHERE doc_id % 4 <> 0),
n AS (SELECT doc_id AS id, CASE WHEN k = 5 THEN '' WHEN k % 2 = 0 THEN text || ' and more' ELSE substr(text, 2) END AS transcript, CASE WHEN k IN (0, 4) THEN 'published' ELSE 'asr' END AS source, 'u' || (k % 4) AS url FROM d WHERE doc_id % 9 <> 0),
j AS (SELECT coalesce(o.id, n.id) AS id, o.transcript AS ot, n.transcript AS nt, o.source AS os, n.source AS ns, o.url AS ou, n.url AS nu,
  CASE o.source WHEN 'published' THEN 2 WHEN 'asr' THEN 1 ELSE 0 END AS a, CASE n.source WHEN 'published' THEN 2 WHEN 'asr' THEN 1 ELSE 0 END AS b FROM o FULL JOIN n ON o.id = n.id),
w AS (SELECT *, coalesce(coalesce(nt, '') <> '' AND (coalesce(ot, '') = '' OR b > a OR (a = b AND ((ns = 'published' AND nu IS DISTINCT FROM ou) OR length(nt) > length(ot)))), false) AS wins FROM j)
SELECT id, CASE WHEN wins THEN nt ELSE ot END AS transcript, CASE WHEN wins THEN ns ELSE os END AS source, CASE WHEN wins THEN nu ELSE ou END AS url FROM w""")
def cache_merge_rank(spark, sf_dir):
    return feeds.merge_cache(*_cached(spark, sf_dir))


@query("SELECT c_name AS name, 'old' AS origin FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_name, 'new' FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 <> 0")
def presets_union(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    part = lambda cond, origin: c.where(cond).select(F.col("c_name").alias("name"), F.lit(origin).alias("origin"))
    return feeds.union_by_name(part("c_custkey % 2 = 0", "old"), part("c_custkey % 3 = 0", "new"))


@query("SELECT count(*) FILTER (doc_id % 3 = 0) AS kept, count(*) AS known, count(*) >= 4 AND count(*) FILTER (doc_id % 3 = 0) < count(*) * 0.5 AS churned FROM documents")
def id_churn(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    return feeds.churn(d, d.where("id % 3 = 0"))


@query("SELECT i.event_id AS id FROM events i WHERE epoch(i.ts) <= (SELECT max(epoch(ts)) FROM events) - 3600 AND i.event_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0)")
def image_gc(spark, sf_dir):
    images = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"))
    now = images.agg(F.max("ts")).first()[0]
    return feeds.unreferenced(images, table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("id")), now).select("id")


@query("SELECT p_partkey, CASE WHEN k = 0 THEN p_brand ELSE p_brand || ' (' || k || ')' END AS unique_name FROM (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS k FROM part)")
def unique_names(spark, sf_dir):
    return feeds.unique_names(table(spark, sf_dir, "part"), "p_brand", "p_partkey").select("p_partkey", "unique_name")


@query("SELECT (doc_id % 4)::int AS lane, count(*) AS n, sum(length(text))::bigint AS chars FROM documents GROUP BY 1")
def round_robin_lanes(spark, sf_dir):
    return feeds.lanes(table(spark, sf_dir, "documents"), 4, "doc_id").groupBy("lane").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("SELECT event_type AS model FROM events GROUP BY 1 HAVING count(DISTINCT user_id % 3) = (SELECT count(DISTINCT user_id % 3) FROM events)")
def common_models(spark, sf_dir):
    return feeds.common_models(table(spark, sf_dir, "events").select(F.col("event_type").alias("model"), (F.col("user_id") % 3).alias("server")))
