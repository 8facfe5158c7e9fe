"""Queries of lookups with fallbacks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessel.operators import lookups as L
from tessel.plans.registry import query, table


@query("""SELECT d.doc_id, CASE WHEN d.doc_id % 4 = 0 THEN 'live ' || d.doc_id WHEN d.doc_id % 3 = 0 THEN 'kept ' || d.doc_id ELSE d.doc_id::varchar END AS label FROM documents d""")
def excerpt_labels(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("item_id"), F.col("source").alias("source_id"))
    rows = d.withColumn("meta", F.when(F.col("doc_id") % 3 == 0, F.to_json(F.struct(F.concat(F.lit("kept "), "item_id").alias("label")))).otherwise("bad"))
    live = d.where("doc_id % 2 = 0").select("item_id", F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("live "), "item_id")).otherwise(" ").alias("label"))
    return L.with_labels(rows, live).select("doc_id", "label")


@query("""WITH u AS (SELECT page_id, 'https://example.org' || CASE WHEN page_id % 2 = 0 THEN '' ELSE ':8080' END || '/Feed?Id=' || page_id AS n FROM pages)
SELECT page_id, sha256(n)[1:40] AS feed, CASE page_id % 3 WHEN 0 THEN 'guid' WHEN 1 THEN 'enclosure' ELSE 'link' END AS taken, sha256(sha256(n)[1:40] || chr(0) || 'k' || page_id)[1:40] AS episode FROM u""")
def episode_ids(spark, sf_dir):
    p, k = table(spark, sf_dir, "pages"), F.col("page_id") % 3
    url = F.concat(F.lit(" HTTPS://Example.org:"), F.when(F.col("page_id") % 2 == 0, "443").otherwise("8080"), F.lit("/Feed?Id="), "page_id", F.lit("#top "))
    value = F.concat(F.lit("k"), "page_id")
    key = L.episode_key(F.when(k == 0, value).otherwise(" "), F.when(k <= 1, value), value)
    own = p.select("page_id", L.feed_id(url).alias("feed"), key.alias("k"))
    return own.select("page_id", "feed", F.col("k.from").alias("taken"), L.episode_id(F.col("feed"), F.col("k.key")).alias("episode"))


@query("""WITH e AS (SELECT o_orderkey AS pos, o_custkey::varchar AS guid, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE '' END AS enclosure, o_orderkey AS extra FROM orders WHERE o_orderkey % 50 = 0),
g AS (SELECT guid, arg_min(extra, pos) AS x FROM e GROUP BY 1), c AS (SELECT enclosure, arg_min(extra, pos) AS x FROM e WHERE enclosure <> '' GROUP BY 1)
SELECT o.o_orderkey, coalesce(g.x, c.x) AS extra FROM orders o LEFT JOIN g ON g.guid = o.o_custkey::varchar LEFT JOIN c ON c.enclosure = o.o_orderpriority""")
def ladder_join(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("guid", F.col("o_custkey").cast("string"))
    right = o.where("o_orderkey % 50 = 0").select(F.col("o_orderkey").alias("pos"), "guid", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).otherwise("").alias("enclosure"), F.col("o_orderkey").alias("extra"))
    return L.by_ladder(o.withColumnRenamed("o_orderpriority", "enclosure"), right, ["guid", "enclosure"], "extra").select("o_orderkey", "extra")


@query("""WITH l AS (SELECT user_id AS item, event_id AS pos, event_id AS url, ['application/json', 'text/vtt', 'application/pdf', 'text/plain'][event_id % 4 + 1] AS type, event_id % 3 = 0 AS cap, ['en', 'de', ''][event_id % 3 + 1] AS lang FROM events)
SELECT item, row_number() OVER (PARTITION BY item ORDER BY list_position(['application/json', 'text/vtt', 'text/plain'], type), NOT cap, NOT (lang = '' OR starts_with(lang, 'de')), pos) - 1 AS rank, url::varchar AS url FROM l WHERE type <> 'application/pdf'""")
def transcript_links(spark, sf_dir):
    i = F.col("event_id")
    kind = F.element_at(F.array(*[F.lit(t) for t in (" Application/JSON", "text/vtt", "application/pdf", "text/plain")]), (i % 4 + 1).cast("int"))
    lang = F.element_at(F.array(F.lit("en"), F.lit("de"), F.lit(None).cast("string")), (i % 3 + 1).cast("int"))
    links = table(spark, sf_dir, "events").select(F.col("user_id").alias("item"), i.alias("pos"), i.cast("string").alias("url"), kind.alias("type"), F.when(i % 3 == 0, "captions").alias("rel"), lang.alias("language"))
    return L.ranked_links(links, "de-DE")


@query("""WITH c AS (SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'ollama' ELSE coalesce(lower(c_mktsegment), 'ollama') END AS kind FROM customer)
SELECT c_custkey, CASE WHEN kind = 'ollama' THEN CASE WHEN c_custkey % 2 = 0 AND c_custkey > 0 THEN c_custkey * 10 ELSE 4096 END WHEN kind = 'machinery' THEN 200000 ELSE 8192 END::bigint AS tokens FROM c""")
def context_windows(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "ollama").otherwise(F.lower("c_mktsegment"))
    return c.select("c_custkey", L.context_window(kind, F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey") * 10), 4096, {"machinery": 200000}, 8192).cast("long").alias("tokens"))


@query("SELECT p_partkey, regexp_matches(lower('x' || p_name || CASE p_partkey % 3 WHEN 0 THEN '-Thinking' WHEN 1 THEN '/r1' ELSE '' END), 'qwq|reasoning|-thinking|/r1|cogito|magistral|thinker') AS reasons FROM part")
def reasoning_models(spark, sf_dir):
    k = F.col("p_partkey") % 3
    return table(spark, sf_dir, "part").select("p_partkey", L.looks_like_reasoning(F.concat(F.lit("x"), "p_name", F.when(k == 0, "-Thinking").when(k == 1, "/r1").otherwise(""))).alias("reasons"))


@query("SELECT 0 AS source_pos, doc_id AS item_pos, doc_id::varchar AS item FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT 1, page_id, url FROM pages")
def ordered_sources(spark, sf_dir):
    a = table(spark, sf_dir, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").cast("string").alias("item"), F.col("doc_id").alias("item_pos"))
    b = table(spark, sf_dir, "pages").select(F.col("url").alias("item"), F.col("page_id").alias("item_pos"))
    return L.ordered_union([a, b], ["item"])


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'a.mp3?x=1' WHEN 1 THEN 'v' WHEN 2 THEN NULL ELSE 'c.MP4' END AS href FROM events")
def first_media(spark, sf_dir):
    i, e = F.col("event_id") % 4, lambda href, kind: F.struct(F.lit(href).alias("href"), F.lit(kind).alias("type"))
    pdf = e("doc.pdf", "application/pdf")
    own = F.when(i == 0, F.array(pdf, e("a.mp3?x=1", "application/octet-stream"))).when(i == 1, F.array(e(" ", "audio/mpeg"), e("v", "Video/mp4"))).when(i == 2, F.array(pdf)).otherwise(F.array(e("c.MP4", None)))
    return table(spark, sf_dir, "events").select("event_id", L.first_media(own)["href"].alias("href"))
