"""Queries of rendering, assembly, trees, cache rules and approximate search."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessel.operators import ann, batch, chat, feeds, render
from tessel.plans.conversations import messages
from tessel.plans.registry import query, table

#: Lists of sixteen that a query looks into: with 8 its recall was 0.83 on sf0.1.
PROBES = 12


_BLOCKS = """blocks AS (SELECT source AS library, doc_id AS pos, '<item label="' || coalesce(lang, '') || '">' || chr(10) || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || chr(10) || '</item>' AS block FROM documents WHERE coalesce(text, '') <> '')"""


def blocks(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return render.library_context(d.select(F.col("source").alias("library"), F.col("doc_id").alias("pos"), F.col("lang").alias("label"), F.col("text").alias("content")))


@query(f"WITH {_BLOCKS} SELECT * FROM blocks")
def library_context(spark, sf_dir):
    return blocks(spark, sf_dir)


@query(f"""WITH {_BLOCKS}, t AS (SELECT *, sum(greatest(1, ceil(length(block) / 4.0))) OVER (PARTITION BY library ORDER BY pos) AS t FROM blocks)
SELECT library, string_agg(block, chr(10) ORDER BY pos) AS context FROM t WHERE t <= 2000 GROUP BY 1""")
def library_budget(spark, sf_dir):
    """What of each library fits into 2000 tokens."""
    return render.within_context(blocks(spark, sf_dir), 2000)


@query("""WITH m AS (SELECT conv_id AS chat, turn, role, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) AS u FROM conversations),
x AS (SELECT chat, turn * 2 AS k, role FROM m UNION ALL SELECT chat, coalesce(max(u) * 2 - 1, max(turn) * 2 + 1), 'extra' FROM m GROUP BY chat)
SELECT chat, string_agg(role, ',' ORDER BY k) AS roles FROM x GROUP BY chat""")
def before_last_user(spark, sf_dir):
    own = render.conversation(messages(spark, sf_dir))
    extra = F.struct(F.lit("extra").alias("role"), F.lit("passages").alias("content"))
    return own.select("chat", F.array_join(F.transform(render.before_last_user(F.col("messages"), extra), lambda m: m["role"]), ",").alias("roles"))


@query("SELECT page_id, '# Source: page ' || page_id || chr(10) || url || chr(10) || chr(10) || html || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '# Prompt' || chr(10) || chr(10) || CASE WHEN page_id % 2 = 0 THEN 'p' ELSE '' END || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '# Response' || chr(10) || chr(10) || upper(url) AS body FROM pages")
def export_body(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    own = batch.body(F.concat(F.lit("page "), "page_id"), F.col("url"), F.col("html"), F.when(F.col("page_id") % 2 == 0, "p"), F.upper("url"), True, True)
    return p.select("page_id", own.alias("body"))


@query("""WITH o AS (SELECT p_brand AS grp, p_type AS cat, 'n' || (p_partkey % 5) AS prompt, p_partkey::varchar AS text, p_partkey AS pos FROM part WHERE p_partkey % 5 = 0),
n AS (SELECT p_brand AS grp, p_type AS cat, 'n' || (p_partkey % 5) AS prompt, p_partkey::varchar AS text, p_partkey AS pos FROM part WHERE p_partkey % 3 <> 1 AND p_partkey % 5 < 2),
f AS (SELECT n.* FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.grp = n.grp AND o.cat = n.cat AND o.prompt = n.prompt AND o.text = n.text)),
k AS (SELECT f.*, row_number() OVER (PARTITION BY grp, cat, prompt ORDER BY pos) + (SELECT count(*) FROM o WHERE o.grp = f.grp AND o.cat = f.cat AND o.prompt = f.prompt) AS k FROM f)
SELECT grp AS "group", cat AS category, prompt, text FROM o UNION ALL SELECT grp, cat, CASE WHEN k = 1 THEN prompt ELSE prompt || ' (' || k || ')' END, text FROM k""")
def merge_trees(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.lit("system").alias("kind"), F.col("p_brand").alias("group"), F.col("p_type").alias("category"), F.concat(F.lit("n"), F.col("p_partkey") % 5).alias("prompt"), F.col("p_partkey").cast("string").alias("text"), F.col("p_partkey").alias("pos"))
    return render.merge_trees(p.where("pos % 5 = 0"), p.where("pos % 3 <> 1 and pos % 5 < 2")).select("group", "category", "prompt", "text")


@query("SELECT chat, id FROM (SELECT user_id AS chat, event_id AS id, sum(event_id % 90 + 10) OVER (PARTITION BY user_id ORDER BY event_id) AS t FROM events) WHERE t <= 300")
def image_budget(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("chat"), F.col("event_id").alias("id"), (F.col("event_id") % 90 + 10).alias("size"))
    return render.within_budget(e, 300).select("chat", "id")


@query("SELECT event_id, regexp_matches(props, '\"k\"') AS ok FROM events")
def schema_keys(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", render.has_keys(F.col("props"), ["k"]).alias("ok"))


@query(r"""WITH p AS (SELECT doc_id, text, substr(text, greatest(1, length(text) // 2), greatest(1, length(text) // 3)) AS part FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(part, '\S') THEN position(part IN text) - 1 END AS first, CASE WHEN regexp_matches(part, '\S') THEN position(part IN text) - 1 + length(part) END AS last FROM p""")
def passage_offsets(spark, sf_dir):
    """A third of each text, from its middle on, in the whole text (the first place where it stands)."""
    part = F.expr("substr(text, greatest(1, length(text) div 2), greatest(1, length(text) div 3))")
    return table(spark, sf_dir, "documents").withColumn("at", render.locate(F.col("text"), part)).select("doc_id", F.col("at")[0].alias("first"), F.col("at")[1].alias("last"))


@query("SELECT c_custkey, '10.' || (c_custkey // 65536) % 256 || '.' || (c_custkey // 256) % 256 || '.' || c_custkey % 256 AS first, 5 AS n FROM customer")
def address_ranges(spark, sf_dir):
    start = F.col("c_custkey") + F.lit(10 * 2**24)
    own = render.addresses(start, start + 4)
    return table(spark, sf_dir, "customer").select("c_custkey", own[0].alias("first"), F.size(own).alias("n"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 1 AND event_id % 3 <> 0 THEN false WHEN event_id % 5 <> 0 THEN true ELSE event_id % 2 = 0 AND event_id % 7 <> 0 END AS covered FROM events""")
def cache_coverage(spark, sf_dir):
    i = F.col("event_id")
    own = feeds.covered(F.when(i % 4 == 1, "new"), F.when(i % 5 != 0, "text"), F.when(i % 3 == 0, "published").otherwise("asr"), F.lit("old"), i % 2 == 0, i % 7 == 0)
    return table(spark, sf_dir, "events").select("event_id", own.alias("covered"))


@query("""WITH o AS (SELECT doc_id AS id, 'old ' || doc_id AS title, text AS t, doc_id % 5 AS c FROM documents WHERE doc_id % 3 <> 0),
n AS (SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN doc_id::varchar ELSE 'new ' || doc_id END AS title, CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'new ' || text END AS t, doc_id % 7 AS c FROM documents WHERE doc_id % 5 <> 0)
SELECT coalesce(o.id, n.id)::varchar AS id, CASE WHEN coalesce(n.title, '') <> '' AND n.title <> n.id::varchar THEN n.title ELSE coalesce(o.title, n.title) END AS title, CASE WHEN coalesce(n.t, '') <> '' THEN n.t ELSE o.t END AS transcript,
  (CASE WHEN coalesce(n.c, -1) >= coalesce(o.c, -1) THEN n.c ELSE o.c END)::int AS comments FROM o FULL JOIN n ON o.id = n.id""")
def video_cache_merge(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("id", F.col("doc_id").cast("string"))
    list_of = lambda n: F.slice(F.array(*[F.lit("c")] * 7), F.lit(1), (F.col("doc_id") % n).cast("int"))
    old = d.where("doc_id % 3 <> 0").select("id", F.concat(F.lit("old "), "id").alias("title"), F.col("text").alias("transcript"), list_of(5).alias("comments"))
    title = F.when(F.col("doc_id") % 4 == 0, F.col("id")).otherwise(F.concat(F.lit("new "), "id"))
    new = d.where("doc_id % 5 <> 0").select("id", title.alias("title"), F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.concat(F.lit("new "), "text")).alias("transcript"), list_of(7).alias("comments"))
    return feeds.merge_video(old, new).withColumn("comments", F.size("comments"))


@query("SELECT count(*) AS entries, sum(strlen(text))::bigint AS bytes, count(*) FILTER (doc_id % 3 = 0) AS transcribed FROM documents")
def cache_stats(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return feeds.cache_stats(d.select(F.col("text").alias("transcript"), F.when(F.col("doc_id") % 3 == 0, "asr").otherwise("published").alias("source")))


@query("SELECT source || '-' || doc_id AS feed FROM documents WHERE doc_id % 4 = 0 OR doc_id % 9 = 0")
def changed_listings(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("feed", F.concat("source", F.lit("-"), "doc_id"))
    old = d.where("doc_id % 9 <> 0").select("feed", F.sha2(F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("hash"))
    return feeds.changed_listings(old, d.select("feed", F.col("text").alias("body"))).select("feed")


@query(r"""SELECT conv_id AS chat, turn AS idx, turn % 3 = 0 OR conv_id % 4 = 0 OR (turn % 3 = 1 AND len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) >= 12) AS active FROM conversations""")
def search_activation(spark, sf_dir):
    t = F.col("idx") % 3
    m = messages(spark, sf_dir).withColumns({"mode": F.when(t == 0, "on").when(t == 1, "auto").otherwise("off"), "libraries": F.when(F.col("chat") % 4 == 0, F.array(F.lit("l")))})
    return m.select("chat", "idx", chat.search_active("content", "mode", "libraries", 12).alias("active"))


@query()
def ann_topk(spark, sf_dir):
    """Lists of all vectors, probed by every twentieth of them; the tests hold its recall against the exact search."""
    own = table(spark, sf_dir, "embeddings")
    centroids = ann.fit(own, 16, key="vec_id")
    asked = own.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), "embedding")
    return ann.search(ann.assign(own, centroids), centroids, asked, 10, PROBES, "vec_id", least=0).select("query", "vec_id", F.round("score", 6).alias("score"), "rank")
