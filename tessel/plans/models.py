"""Queries over what a model says of rows, and over the small lookups around it. Models here are rules over the prompt."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tessel.functions.text import INDEXED, defang, media_type, word_windows
from tessel.operators import answers, evals, index, lookups, personas, staging, steps
from tessel.plans.registry import query, table


def _measured(prompts: list) -> list:
    """The length and the last five characters of a prompt; nothing for lengths that can be divided by 7."""
    return [f"{len(p)}:{p[-5:]}" if len(p) % 7 else None for p in prompts]


_MEASURE = "CASE WHEN length({0}) % 7 <> 0 THEN length({0}) || ':' || right({0}, 5) END"


@query(f"""WITH a AS (SELECT conv_id || '/' || turn || '/' || md5(text) AS "row", text AS p, {_MEASURE.format("text")} AS a0 FROM conversations WHERE text IS NOT NULL GROUP BY conv_id, turn, text),
b AS (SELECT *, p || ' | ' || coalesce(a0, '') AS q1 FROM a), c AS (SELECT *, coalesce({_MEASURE.format("q1")}, a0) AS a1 FROM b),
d AS (SELECT *, p || ' | ' || coalesce(a1, '') AS q2 FROM c), e AS (SELECT *, coalesce({_MEASURE.format("q2")}, a1) AS a2 FROM d)
SELECT "row", 0 AS round, a0 AS answer, true AS intermediate FROM e UNION ALL SELECT "row", 1, a1, true FROM e UNION ALL SELECT "row", 2, a2, false FROM e""")
def refined_answers(spark, sf_dir):
    """Every turn is a prompt, answered and reviewed twice; a round without a reply keeps the answer before."""
    turns = table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    rows = turns.select(F.concat_ws("/", "conv_id", "turn", F.md5("text")).alias("row"), F.col("text").alias("prompt")).distinct()
    return steps.refined(rows, _measured, "{{ prompt }} | {{ answer }}")


def _placed(prompts: list) -> list:
    """The first word of the document and the first ten characters of the excerpt; nothing for excerpts of even length."""
    out = []
    for p in prompts:
        about, rest = p.removeprefix("Document:\n").split("\n\nExcerpt:\n", 1)
        excerpt = rest.rsplit("\n\n", 1)[0]
        out.append(f"{about.split(' ', 1)[0]}~{excerpt[:10]}" if len(excerpt) % 2 else None)
    return out


@query(r"""WITH i AS (SELECT doc_id AS item_id, regexp_extract_all(text, '[^\s\x0B]+') AS w FROM documents WHERE text IS NOT NULL),
spread AS (SELECT item_id, w, unnest(CASE WHEN len(w) <= 512 THEN [0] ELSE range(0, ceil((len(w) - 512) / 448.0)::int + 1) END)::int AS k FROM i)
SELECT item_id, content, CASE WHEN length(content) % 2 = 1 THEN regexp_replace(first || '~' || left(content, 10), '^[\s\x0B]+|[\s\x0B]+$', '', 'g') ELSE '' END AS context
FROM (SELECT item_id, array_to_string(w[k * 448 + 1 : k * 448 + 512], ' ') AS content FROM spread) JOIN (SELECT item_id, coalesce(w[1], '') AS first FROM i) USING (item_id)""")
def situated_chunks(spark, sf_dir):
    """Each window of 512 words, 64 shared, of every document is a chunk that a model places within the document; one of white
    space is an empty chunk."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("item_id"), F.col("text").alias("content"))
    chunks = docs.select("item_id", F.explode_outer(word_windows("content", *INDEXED)).alias("content")).fillna("", ["content"])
    return steps.situated(chunks, docs, _placed)


def _reworded(prompts: list) -> list:
    """The instruction in capitals, with a label that should not be there; nothing for buildings."""
    own = [p.split("Original instruction:\n", 1)[1].removesuffix("\n\nRewritten instruction:") for p in prompts]
    return [None if "BUILDING" in t else f" Rewritten instruction: Please {t} after {p.count('Conversation context')}" for p, t in zip(prompts, own)]


@query("""WITH i AS (SELECT c_custkey AS "row", CASE WHEN c_custkey % 5 = 0 THEN ' ' ELSE c_mktsegment || ' of ' || c_name END AS text, CASE WHEN c_custkey % 3 = 0 THEN 'User: hello' END AS history FROM customer)
SELECT "row", text, CASE WHEN trim(text) = '' OR contains(text, 'BUILDING') THEN text ELSE 'Please ' || text || ' after ' || (history IS NOT NULL)::int END AS better FROM i""")
def improved_instructions(spark, sf_dir):
    key = F.col("c_custkey")
    text = F.when(key % 5 == 0, " ").otherwise(F.concat("c_mktsegment", F.lit(" of "), "c_name"))
    rows = table(spark, sf_dir, "customer").select(key.alias("row"), text.alias("text"), F.when(key % 3 == 0, "User: hello").alias("history"))
    return steps.improved(rows, _reworded).drop("history")


def _variants(prompts: list) -> list:
    """Three variants and a keyword as JSON in prose; no JSON where the message has a digit 7."""
    own = [p.split("User message:\n", 1)[1].removesuffix("\n\nJSON:") for p in prompts]
    return ["no idea" if "7" in m else "Sure: " + json.dumps({"queries": [m.upper(), " ", m, 4, m + "?"], "keywords": [m[:3]]}) for m in own]


@query("""WITH q AS (SELECT o_orderkey AS query, CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE lower(o_orderpriority) || ' order ' || o_orderkey END AS m FROM orders)
SELECT query, CASE WHEN m = '' THEN '' WHEN contains(m, '7') THEN m ELSE upper(m) || '|' || m || '|' || m || '?' END AS variants, CASE WHEN m = '' OR contains(m, '7') THEN '' ELSE left(m, 3) END AS keywords FROM q""")
def rewritten_questions(spark, sf_dir):
    """A question about each order in other words; those that no reply can be read for stay as they are."""
    message = F.when(F.col("o_orderkey") % 6 == 0, "").otherwise(F.concat(F.lower("o_orderpriority"), F.lit(" order "), "o_orderkey"))
    found = answers.rewritten(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query"), message.alias("q"), F.lit("").alias("history")), _variants)
    return found.select("query", F.array_join("variants", "|").alias("variants"), F.array_join("keywords", "|").alias("keywords"))


@query("""SELECT c_custkey AS "row", CASE WHEN c_custkey % 4 <> 0 THEN c_name ELSE '' END AS name, CASE WHEN c_custkey % 4 <> 0 THEN c_nationkey::varchar ELSE '' END AS nation, '' AS missing FROM customer""")
def generated_fields(spark, sf_dir):
    """Replies with fields as fenced JSON; every fourth one has none that can be read."""
    body = F.to_json(F.struct(F.concat(F.lit(" "), "c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.lit(1).alias("other")))
    reply = F.when(F.col("c_custkey") % 4 == 0, "{not json").otherwise(F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```")))
    return evals.generated_rows(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row"), reply.alias("reply")), ["name", "nation", "missing"])


def _drafted(prompts: list) -> list:
    if any("3" in p for p in prompts):
        raise ValueError("three")
    return [f" {p}! " for p in prompts]


@query("""WITH s AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS rowid, c_name, c_mktsegment FROM customer), d AS (SELECT *, NOT contains(c_name, '3') AS ok FROM s)
SELECT rowid, 'draft' AS col, CASE WHEN ok THEN 'For ' || c_name || '!' END AS value, CASE WHEN NOT ok THEN 'ValueError: three' END AS error, 0 AS seq FROM d
UNION ALL SELECT rowid, 'found', left('hits of ' || c_mktsegment || CASE WHEN ok THEN ' For ' || c_name || '!' ELSE '' END, 40), NULL, 1 FROM d""")
def processed_columns(spark, sf_dir):
    """A column from a model, and one from a search that sees the first; rows that fail go on."""
    own = staging.stage(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), ["c_custkey"])
    columns = [{"name": "draft", "kind": "prompt", "template": "For {c_name}"}, {"name": "found", "kind": "search", "template": "{c_mktsegment} {draft} "}]
    own = staging.add_column(staging.add_column(own, "draft"), "draft")
    return staging.process(own, columns, _drafted, lambda texts: [f"hits of {t}" for t in texts], most=40)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 > 1 THEN NULL ELSE round(o_totalprice, 1)::decimal(18, 1)::double END AS score FROM orders")
def scores_read(spark, sf_dir):
    """Scores that a grader wrote as numbers, within words, as null or as true."""
    price = F.format_string("%.1f", F.round("o_totalprice", 1))
    kind = F.col("o_orderkey") % 4
    value = F.when(kind == 0, price).when(kind == 1, F.concat(F.lit("about "), price, F.lit(" of 9"))).when(kind == 2, "null").otherwise("true")
    return table(spark, sf_dir, "orders").select("o_orderkey", evals.coerce_score(value).alias("score"))


@query("""SELECT doc_id, sha256(array_to_string(list_transform(string_split('== ' || source || ' ==' || chr(10) || coalesce(text, ''), chr(10)),
lambda x: CASE WHEN regexp_matches(x, '^\\s*={2,}.*={2,}\\s*$') THEN replace(x, '=', '-') ELSE x END), chr(10))) AS digest FROM documents WHERE source IS NOT NULL""")
def defanged_documents(spark, sf_dir):
    text = F.concat(F.lit("== "), "source", F.lit(" ==\n"), F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").where("source IS NOT NULL").select("doc_id", F.sha2(defang(text), 256).alias("digest"))


_HEADS = ["89504E470D0A1A0A", "FFD8FFE0", "474946383961", "524946460000000057454250", "000000206674797061766966", "0000002066747970686569", "424D", "25504446"]
_MEDIA = ["image/png", "image/jpeg", "image/gif", "image/webp", "image/avif", "image/heic", "image/bmp", ""]


@query(f"SELECT event_id, ({_MEDIA!r})[event_id % 8 + 1] AS media FROM events")
def media_types(spark, sf_dir):
    """Events as payloads behind the first bytes of eight formats."""
    head = F.element_at(F.array(*[F.lit(h) for h in _HEADS]), (F.col("event_id") % 8 + 1).cast("int"))
    data = F.concat(F.unhex(head), F.coalesce("props", F.lit("")).cast("binary"))
    return table(spark, sf_dir, "events").select("event_id", media_type(data).alias("media"))


@query("SELECT 'm' || (label % 3) AS model, coalesce(len(embedding), 0) AS dims, count(*) AS rows, count(nullif(len(embedding), 0)) AS embedded FROM (SELECT label, CASE WHEN vec_id % 9 <> 0 THEN embedding END AS embedding FROM embeddings) GROUP BY 1, 2")
def index_status(spark, sf_dir):
    """Every ninth vector is not there yet."""
    vector = F.when(F.col("vec_id") % 9 != 0, F.col("embedding"))
    own = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("m"), F.col("label") % 3).alias("model"), vector.alias("embedding"))
    return index.status(own).fillna(0, ["dims"])


@query("""WITH c AS (SELECT o_orderstatus AS source_type, o_custkey AS source_id, count(*) AS source, count(*) FILTER (o_orderkey % 13 <> 0) AS copy FROM orders GROUP BY 1, 2) SELECT *, source = copy AS ok FROM c""")
def verified_copies(spark, sf_dir):
    """A copy of the orders' scopes that lacks some rows, and with them some whole scopes."""
    own = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("source_type"), F.col("o_custkey").alias("source_id"))
    return index.verified_copy(own, own.where("o_orderkey % 13 <> 0"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN left(sha256('{"o_orderkey":' || o_orderkey || '}'), 12) ELSE 'o' || o_orderkey END AS id, o_orderkey % 4 = 0 AS filled FROM orders""")
def filled_ids(spark, sf_dir):
    key = F.col("o_orderkey")
    own = table(spark, sf_dir, "orders").select("o_orderkey", F.when(key % 8 == 0, "").when(key % 4 != 0, F.concat(F.lit("o"), key)).alias("id"))
    return lookups.with_ids(own, ["o_orderkey"])


@query("SELECT l_orderkey AS id, l_linenumber AS rank, l_extendedprice AS score, o_orderstatus FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderkey % 9 <> 0")
def index_hits(spark, sf_dir):
    """Line items are hits of an index whose rows, the orders, are partly gone."""
    hits = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("rank"), F.col("l_extendedprice").alias("score"))
    return lookups.by_id(hits, table(spark, sf_dir, "orders").where("o_orderkey % 9 <> 0").select(F.col("o_orderkey").alias("id"), "o_orderstatus"))


@query("""SELECT c_custkey, c_mktsegment <> 'BUILDING' AS has_password, c_custkey % 3 = 0 AS has_token, CASE c_custkey % 5 WHEN 0 THEN 'thread' WHEN 1 THEN 'both' ELSE 'attachments' END AS scope FROM customer""")
def masked_profiles(spark, sf_dir):
    """Customers as profiles with two secrets, and what their chats search."""
    key = F.col("c_custkey")
    scope = F.element_at(F.array(F.lit(" Thread"), F.lit("BOTH"), F.lit("attachments"), F.lit("all"), F.lit(None)), (key % 5 + 1).cast("int"))
    own = table(spark, sf_dir, "customer").select(key, F.when(F.col("c_mktsegment") != "BUILDING", "x").otherwise("").alias("password"), F.when(key % 3 == 0, key).alias("token"), lookups.search_scope(scope).alias("scope"))
    return lookups.masked(own, ["password", "token", "key_file"])


@query("SELECT event_id, event_type AS body, (event_id % 3)::int AS v FROM events WHERE event_id % 3 = 2 AND event_id % 5 <> 0 AND event_type IS NOT NULL")
def usable_entries(spark, sf_dir):
    """Cache entries of three versions, some of which could not be read."""
    at = F.col("event_id")
    return lookups.cached(table(spark, sf_dir, "events").select(at, F.when(at % 5 != 0, F.col("event_type")).alias("body"), (at % 3).cast("int").alias("v")), 2)


@query("""SELECT 'persona_memory' AS source_type, conv_id AS source_id, turn AS item_id, trim(role || chr(10) || CASE WHEN turn % 3 = 0 THEN '' ELSE md5(text) END, chr(10)) AS content, '{"label":"' || role || '"}' AS meta FROM conversations WHERE role IS NOT NULL AND text IS NOT NULL""")
def persona_memories(spark, sf_dir):
    """Turns as memories of a persona; every third one has a title only."""
    own = table(spark, sf_dir, "conversations").where("role IS NOT NULL AND text IS NOT NULL")
    return personas.memory_items(own.select(F.col("conv_id").alias("persona"), F.col("turn").alias("id"), F.col("role").alias("title"), F.when(F.col("turn") % 3 != 0, F.md5("text")).alias("description")))


@query("SELECT c_custkey AS query FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderstatus = 'P')")
def degraded_questions(spark, sf_dir):
    """Customers without a pending order get the full context."""
    found = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("query"))
    return answers.degraded(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query")), found)
