"""Queries over chats: searchable turns, windows of history, data blocks, usage."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessel.functions.text import estimate_tokens, strip_reasoning
from tessel.operators import chat, feeds, memory
from tessel.plans.registry import query, table


def messages(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("chat"), F.col("turn").alias("idx"), "role", F.col("text").alias("content"), (F.col("turn") % 5 >= 3).alias("intermediate"))


def with_data(spark, sf_dir):
    """Data blocks in some turns of either side."""
    return messages(spark, sf_dir).withColumn("content", F.when((F.col("idx") + F.col("chat")) % 3 == 0, F.concat(F.lit("<Data>rows\nof data</Data> "), "content")).otherwise(F.col("content")))


_MESSAGES = "m AS (SELECT conv_id AS chat, turn AS idx, role, text AS content, turn % 5 >= 3 AS intermediate, max(CASE WHEN role = 'user' AND turn % 5 < 3 THEN turn END) OVER (PARTITION BY conv_id) AS last_user FROM conversations)"
_SHOWN = "role IN ('user', 'assistant') AND NOT intermediate"


@query(rf"""WITH {_MESSAGES}, d AS (SELECT *, CASE WHEN (idx + chat) % 3 = 0 AND role <> 'user' THEN '<Data>rows' || chr(10) || 'of data</Data> ' || content ELSE content END AS shown FROM m),
t AS (SELECT chat, idx, role, regexp_replace(shown, '^\s+|\s+$', '', 'g') AS content FROM d WHERE role IN ('user', 'assistant') AND NOT intermediate AND idx IS DISTINCT FROM last_user)
SELECT * FROM t WHERE length(content) >= 40""")
def thread_items(spark, sf_dir):
    """A user's data blocks go, an answer's stay; drafts count neither as turns nor as the last question."""
    return chat.thread_items(with_data(spark, sf_dir))


@query(f"WITH {_MESSAGES} SELECT chat, idx, role FROM m WHERE {_SHOWN} AND idx <= last_user QUALIFY row_number() OVER (PARTITION BY chat ORDER BY idx DESC) <= 3")
def history_window(spark, sf_dir):
    return chat.visible(messages(spark, sf_dir), 3).select("chat", "idx", "role")


@query(f"WITH {_MESSAGES} SELECT chat, idx, role FROM m WHERE {_SHOWN} AND idx = last_user")
def history_isolated(spark, sf_dir):
    return chat.visible(messages(spark, sf_dir), 3, isolated=True).select("chat", "idx", "role")


@query("""WITH t AS (SELECT conv_id AS chat, role, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, ceil(length(text) / 4.0)) END::bigint AS n, turn % 3 = 0 AS rag FROM conversations),
s AS (SELECT chat, coalesce(sum(n) FILTER (role = 'system' AND NOT rag), 0)::bigint AS system, coalesce(sum(CASE WHEN role IN ('system', 'user') AND rag THEN n + 3 END), 0)::bigint AS rag, coalesce(sum(n) FILTER (role = 'user' AND NOT rag), 0)::bigint AS user FROM t GROUP BY chat)
SELECT chat, system, rag, "user", system + rag + "user" AS total FROM s""")
def usage_breakdown(spark, sf_dir):
    """Every third turn holds a mark of retrieved passages, of twelve characters with its space: three tokens more."""
    m = messages(spark, sf_dir).withColumn("content", F.when(F.col("idx") % 3 == 0, F.concat(F.lit("<retrieved> "), "content")).otherwise(F.col("content")))
    return chat.usage(m)


@query("SELECT user_id AS chat, event_id AS call FROM events WHERE event_type <> 'error' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5")
def usage_cap(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("chat"), F.col("event_id").alias("call"), "ts", (F.col("event_type") == "error").alias("private"))
    return chat.capped(e, 5).select("chat", "call")


@query("SELECT conv_id AS chat, turn AS idx, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, ceil(length(text) / 4.0)) END::bigint AS tokens FROM conversations")
def token_estimates(spark, sf_dir):
    return messages(spark, sf_dir).select("chat", "idx", estimate_tokens("content").alias("tokens"))


@query(r"""WITH b AS (SELECT conv_id AS chat, turn, role, regexp_replace(regexp_replace(text, '[<>]', '', 'g'), '^\s+|\s+$', '', 'g') AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k FROM conversations WHERE turn % 5 < 3)
SELECT chat, 'data:' || k AS item_id, regexp_replace(t || chr(10) || chr(10) || 'more', '^\s+', '') AS content FROM b WHERE role = 'user'""")
def data_block_split(spark, sf_dir):
    """Two blocks in every turn, of which the first is the whole text."""
    block = F.concat(F.lit(" <Data> "), F.regexp_replace("content", "[<>]", ""), F.lit("</Data> and <data>more </data> end"))
    return chat.data_items(messages(spark, sf_dir).withColumn("content", F.concat("content", block)))


@query(r"""WITH w AS (SELECT conv_id AS chat, turn AS idx, '<think>plan' || chr(10) || 'more</think>' || text || ' kept<Reasoning>never closed ' || text AS t FROM conversations),
c AS (SELECT chat, idx, regexp_replace(t, '(?is)<think>.*?</think>|<thinking>.*?</thinking>|<reasoning>.*?</reasoning>', '', 'g') AS t FROM w)
SELECT chat, idx, regexp_replace(regexp_replace(t, '(?is)<(think|thinking|reasoning)>.*$', ''), '^\s+|\s+$', '', 'g') AS answer FROM c""")
def strip_reasoning_blocks(spark, sf_dir):
    wrapped = F.concat(F.lit("<think>plan\nmore</think>"), "content", F.lit(" kept<Reasoning>never closed "), "content")
    return messages(spark, sf_dir).select("chat", "idx", strip_reasoning(wrapped).alias("answer"))


@query(r"""WITH c AS (SELECT conv_id AS doc, turn, role AS speaker, text, CASE WHEN lag(role) OVER w IS DISTINCT FROM role THEN 1 ELSE 0 END AS new FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
p AS (SELECT *, sum(new) OVER (PARTITION BY doc ORDER BY turn) - 1 AS para FROM c)
SELECT doc, para::bigint AS para, any_value(speaker) AS speaker, string_agg(text, ' ' ORDER BY turn) AS text FROM p GROUP BY doc, para""")
def speaker_paragraphs(spark, sf_dir):
    c = messages(spark, sf_dir).select(F.col("chat").alias("doc"), F.col("idx").alias("pos"), F.col("role").alias("speaker"), F.col("content").alias("text"))
    return chat.speaker_paragraphs(c)


@query("""SELECT conv_id AS chat, coalesce(string_agg(id, ',' ORDER BY pos) FILTER (id IN (SELECT 'src' || (i * 2) FROM range(0, 10) t(i))), '') AS library_ids
FROM (SELECT DISTINCT conv_id FROM conversations), LATERAL (SELECT * FROM (VALUES (0, 'src' || (conv_id % 20)), (1, 'src' || ((conv_id + 7) % 20)), (2, 'gone')) t(pos, id)) GROUP BY conv_id""")
def orphan_repair(spark, sf_dir):
    chats = messages(spark, sf_dir).select("chat").distinct().withColumn("library_ids", F.array(F.concat(F.lit("src"), F.col("chat") % 20), F.concat(F.lit("src"), (F.col("chat") + 7) % 20), F.lit("gone")))
    libraries = table(spark, sf_dir, "documents").select(F.col("source").alias("id")).distinct().where(F.col("id").isin(*[f"src{2 * i}" for i in range(10)]))
    return chat.repair_references(chats, libraries).withColumn("library_ids", F.array_join("library_ids", ","))


@query("""WITH e AS (SELECT c_nationkey AS core, c_custkey AS id, c_custkey % 10 = 0 AS pinned, (c_custkey % 10) + 1 AS importance FROM customer)
SELECT core::varchar AS core, id::varchar AS id FROM e QUALIFY pinned OR row_number() OVER (PARTITION BY core, pinned ORDER BY importance DESC, id::varchar) <= 2""")
def memory_injected(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    own = c.select(F.col("c_nationkey").cast("string").alias("core"), F.col("c_custkey").cast("string").alias("id"), (F.col("c_custkey") % 10 == 0).alias("pinned"), (F.col("c_custkey") % 10 + 1).alias("importance"), F.lit("t").alias("created"))
    return memory.injected(own, 2).select("core", "id")


@query("""SELECT c_custkey AS id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'goals' ELSE 'other' END AS category, greatest(1, least(10, (c_custkey % 14) - 2))::int AS importance FROM customer WHERE c_custkey % 5 <> 0""")
def memory_normalise(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    category = F.when(F.col("c_mktsegment") == "BUILDING", " Goals ").otherwise(F.col("c_mktsegment"))
    own = c.select(F.col("c_custkey").alias("id"), category.alias("category"), (F.col("c_custkey") % 14 - 2).alias("importance"), F.when(F.col("c_custkey") % 5 == 0, "  ").otherwise("x").alias("text"))
    return memory.normalise(own).select("id", "category", "importance")


@query("""WITH e AS (SELECT c_nationkey AS core, c_custkey AS id, (c_custkey % 10) + 1 AS importance, c_custkey % 8 = 0 AS safe FROM customer)
SELECT core::varchar AS core, id::varchar AS id, CASE WHEN id % 6 = 1 THEN 'edited ' || id ELSE 'fact ' || id END AS text, (CASE WHEN id % 6 = 1 THEN 10 ELSE importance END)::int AS importance FROM e WHERE id % 6 <> 2 OR safe
UNION ALL SELECT core::varchar, core::varchar || '-' || (1000000 + id), 'new ' || id, 5 FROM e WHERE id % 6 = 3""")
def memory_operations(spark, sf_dir):
    """Adds, updates and deletes on the entries of each core; pinned ones are not deleted."""
    c = table(spark, sf_dir, "customer").withColumn("core", F.col("c_nationkey").cast("string")).withColumn("id", F.col("c_custkey").cast("string"))
    entries = c.select("core", "id", F.lit("facts").alias("category"), F.concat(F.lit("fact "), "id").alias("text"), (F.col("c_custkey") % 10 + 1).cast("int").alias("importance"), (F.col("c_custkey") % 8 == 0).alias("pinned"), F.lit("model").alias("origin"), F.lit("t").alias("created"))
    k = F.col("c_custkey") % 6
    ops = c.where(k.isin(1, 2, 3)).select(
        "core", (F.col("c_custkey") + 1000000).alias("seq"), F.when(k == 1, "update").when(k == 2, "delete").otherwise("add").alias("op"), F.when(k != 3, F.col("id")).alias("id"), F.array().cast("array<string>").alias("ids"),
        F.when(k == 1, F.concat(F.lit("edited "), "id")).when(k == 3, F.concat(F.lit("new "), "id")).alias("text"), F.lit("facts").alias("category"), F.when(k == 1, 99).cast("int").alias("importance"),
    )
    return memory.apply_operations(entries, ops).select("core", "id", "text", "importance")


@query("""WITH t AS (SELECT conv_id AS video, turn AS pos, CASE turn % 4 WHEN 0 THEN 'de' WHEN 1 THEN 'en' WHEN 2 THEN 'en-GB' ELSE 'fr' END AS lang, turn % 4 = 2 AS manual FROM conversations WHERE turn <> conv_id % 3),
r AS (SELECT *, CASE WHEN starts_with(lang, 'en') AND manual THEN 0 WHEN starts_with(lang, 'en') THEN 1 ELSE 3 END AS k FROM t)
SELECT video, pos, lang, manual FROM r QUALIFY row_number() OVER (PARTITION BY video ORDER BY k, pos) = 1""")
def caption_pick(spark, sf_dir):
    k = F.col("idx") % 4
    t = messages(spark, sf_dir).where("idx <> chat % 3").select(F.col("chat").alias("video"), F.col("idx").alias("pos"), F.when(k == 0, "de").when(k == 1, "en").when(k == 2, "en-GB").otherwise("fr").alias("lang"), (k == 2).alias("manual"), F.lit("").alias("name"))
    return feeds.caption_pick(t)
