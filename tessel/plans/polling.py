"""Queries over what can fail: fetches, ladders, lanes of a model, files of a store, lists after writes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessel.operators import ann, feeds, index, ladders, pool
from tessel.plans import ingestion
from tessel.plans.registry import query, table
from tessel.sources import manifests
from tessel.streaming import polling
from tessel.tables import discard, shared_dir


@query("""WITH f AS (SELECT user_id AS feed, event_id AS "at", CASE WHEN event_id % 5 = 1 THEN 304 WHEN event_id % 7 = 2 THEN 500 WHEN event_id % 11 = 3 THEN NULL ELSE 200 END AS status, event_type AS body FROM events),
h AS (SELECT *, CASE WHEN status = 200 THEN body END AS h, last_value(CASE WHEN status = 200 THEN body END IGNORE NULLS) OVER (PARTITION BY feed ORDER BY "at" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM f),
s AS (SELECT *, CASE WHEN h = b OR (status = 304 AND b IS NOT NULL) THEN 'same' WHEN h IS NOT NULL THEN 'new' WHEN b IS NOT NULL THEN 'cached' ELSE 'failed' END AS state FROM h)
SELECT feed, "at", state, coalesce(last_value(CASE WHEN state = 'new' THEN "at" END IGNORE NULLS) OVER (PARTITION BY feed ORDER BY "at" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1) AS listing,
CASE state WHEN 'cached' THEN 'The listing read before is used: the feed could not be read (' || coalesce(status::varchar, 'no answer') || ').' WHEN 'failed' THEN 'The feed could not be read (' || coalesce(status::varchar, 'no answer') || ') and no listing was read before.' END AS warning FROM s""")
def feed_listings(spark, sf_dir):
    """Each user's events are fetches of a feed whose listing is the kind of event."""
    at = F.col("event_id")
    status = F.when(at % 5 == 1, 304).when(at % 7 == 2, 500).when(at % 11 == 3, F.lit(None).cast("int")).otherwise(200)
    fetches = table(spark, sf_dir, "events").select(F.col("user_id").alias("feed"), at.alias("at"), status.alias("status"), F.col("event_type").alias("body"))
    return polling.listings(fetches).withColumn("listing", F.coalesce("listing", F.lit(-1)))


_WORDS = "(contains(haystack, 'que') OR contains(haystack, 'la'))"


@query(f"""WITH {ingestion._ITEMS}, c AS (SELECT source AS feed, pos, 0 AS k, lang AS c, lang AS key FROM items UNION ALL
SELECT source, pos, 1, CASE WHEN pos % 3 = 0 THEN 'Src & ' ELSE 'SRC and ' END || source, {ingestion._FOLD.format("'src and ' || source")} FROM items),
n AS (SELECT feed, key, count(*) AS n, min(pos) AS first_at, arg_min(c, (pos, c)) AS c FROM c GROUP BY 1, 2),
t AS (SELECT feed, string_agg(c, '|' ORDER BY k) AS terms FROM (SELECT *, row_number() OVER (PARTITION BY feed ORDER BY n DESC, first_at, c) AS k FROM n) WHERE k <= 12 GROUP BY 1),
m AS (SELECT source AS feed, count(*) AS total, count(*) FILTER (WHERE lang = 'xx' AND {_WORDS}) AS matched FROM items GROUP BY 1)
SELECT feed, total, matched, total AS categorised, terms, 'None of the items pass (categories xx; keywords que, la); a category counts as a whole, and there are: ' || replace(terms, '|', ', ') || '.' AS reason FROM m JOIN t USING (feed)""")
def empty_filter_reasons(spark, sf_dir):
    """A category that no feed has: what each feed has instead."""
    own = feeds.filter_report(ingestion.items(spark, sf_dir), "xx", "que, la")
    return own.withColumn("terms", F.array_join("terms", "|"))


@query("""WITH a AS (SELECT user_id AS id, CASE WHEN event_id % 2 = 0 THEN 'comments' ELSE 'transcript' END AS half, (event_id // 2) % 4 AS rung, min(CASE WHEN event_id % 3 <> 0 AND event_id % 10 <> 4 THEN event_id::varchar END) AS value FROM events GROUP BY 1, 2, 3),
b AS (SELECT id, half, min(CASE WHEN value IS NOT NULL THEN rung END) AS rung FROM a GROUP BY 1, 2)
SELECT id, half, b.rung, (SELECT any_value(value) FROM a WHERE a.id = b.id AND a.half = b.half AND a.rung = b.rung) AS value,
(SELECT count(*) FROM a WHERE a.id = b.id AND a.half = b.half AND a.value IS NULL AND (b.rung IS NULL OR a.rung < b.rung)) AS failed, coalesce(b.rung <> 0, false) AS write FROM b""")
def ladder_halves(spark, sf_dir):
    """Events are attempts at both halves of a user's video: every third one fails, some give a blank."""
    at = F.col("event_id")
    value = F.when(at % 10 == 4, " ").otherwise(at.cast("string"))
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.when(at % 2 == 0, "comments").otherwise("transcript").alias("half"), (F.floor(at / 2) % 4).alias("rung"), (at % 3 != 0).alias("ok"), value.alias("value"))
    return ladders.best_attempts(rows)


@query("""WITH e AS (SELECT o_custkey AS playlist, o_orderkey AS pos, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey::varchar END AS id, CASE WHEN o_orderkey % 5 = 0 THEN '[Private video]' ELSE o_orderpriority END AS title FROM orders)
SELECT playlist, pos, id, title, row_number() OVER (PARTITION BY playlist ORDER BY pos) AS place FROM e WHERE id IS NOT NULL AND title <> '[Private video]'""")
def live_playlist(spark, sf_dir):
    key = F.col("o_orderkey")
    return ladders.live_entries(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("playlist"), key.alias("pos"), F.when(key % 7 != 0, key.cast("string")).alias("id"), F.when(key % 5 == 0, "[Private video]").otherwise(F.col("o_orderpriority")).alias("title")))


def _sizes(lane: str, texts: list) -> list:
    """A model of one number for each text: one lane is broken, and no lane takes a text whose size can be divided by 50."""
    if lane == "broken" or any(len(t) % 50 == 0 for t in texts):
        raise RuntimeError(lane)
    return [[float(len(t))] for t in texts]


def _answered(spark, sf_dir):
    texts = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return pool.asked(texts, "text", _sizes, ["first", "broken", "third"])


@query("SELECT doc_id, length(coalesce(text, '')) % 50 <> 0 AS ok, CASE WHEN length(coalesce(text, '')) % 50 <> 0 THEN length(coalesce(text, ''))::double END AS size FROM documents")
def lane_answers(spark, sf_dir):
    """Every text that can be answered is, whatever else is in its batch."""
    return _answered(spark, sf_dir).select("doc_id", "ok", F.col("answer")[0].alias("size"))


@query("SELECT b AS broken, CASE WHEN b THEN 0 ELSE (SELECT count(*) FROM documents WHERE length(coalesce(text, '')) % 50 <> 0) END AS inputs, true AS failed FROM (SELECT unnest([true, false]) AS b)")
def lane_throughput(spark, sf_dir):
    """What the broken lane and the others answered."""
    own = pool.throughput(_answered(spark, sf_dir))
    return own.groupBy((F.col("lane") == "broken").alias("broken")).agg(F.sum("inputs").alias("inputs"), (F.sum("failures") > 0).alias("failed"))


@query("SELECT CASE WHEN o_orderstatus = 'F' THEN 'missing' ELSE 'ok' END AS state, count(*) AS rows, count(*) FILTER (WHERE o_orderstatus <> 'F') AS found FROM orders GROUP BY 1")
def store_damage(spark, sf_dir):
    """Orders as a folder by status, of which one part is lost."""
    path = f"{shared_dir(spark)}/orders"
    table(spark, sf_dir, "orders").write.partitionBy("o_orderstatus").parquet(path)
    manifests.record(spark, path)
    discard(spark, f"{path}/o_orderstatus=F")
    return manifests.check(spark, path).groupBy("state").agg(F.sum("rows").alias("rows"), F.sum("found").alias("found"))


@query("SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'library:' ELSE 'persona:' END || o_custkey || CASE WHEN o_orderkey % 3 > 0 THEN '@' || o_orderstatus ELSE '' END AS key, o_orderkey FROM orders WHERE NOT (o_orderkey % 2 = 0 AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5))")
def forgotten_sources(spark, sf_dir):
    """Manifest entries of libraries and personas under several backends; the libraries of some nations' customers are forgotten."""
    kind, backend = F.when(F.col("o_orderkey") % 2 == 0, "library").otherwise("persona"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderstatus"))
    entries = table(spark, sf_dir, "orders").select(index.manifest_key(kind, F.col("o_custkey").cast("string"), backend).alias("key"), "o_orderkey")
    gone = table(spark, sf_dir, "customer").where("c_nationkey < 5").select(F.lit("library").alias("kind"), F.col("c_custkey").alias("id"))
    return index.forget(entries, gone)


def after_writes(spark, sf_dir):
    """Lists of the embeddings after two writes without a new fit, and the lists' own repair: every fifth row gets the vector of its neighbour in the table turned about, every
    seventh goes; (assigned, centroids)."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    centroids = ann.fit(rows, 16, key="vec_id")
    turned = rows.where("vec_id % 5 = 1").select("vec_id", F.reverse("embedding").alias("embedding"))
    assigned = ann.changed(ann.assign(rows, centroids), centroids, turned, rows.where("vec_id % 7 = 3").select("vec_id"), "vec_id")
    assigned = ann.changed(assigned, centroids, rows.where("vec_id % 35 = 3"), rows.where("vec_id % 11 = 5").select("vec_id"), "vec_id")
    return ann.rebuilt(assigned, centroids, grown=1.5, dead=0.2, key="vec_id")


@query("""WITH r AS (SELECT vec_id, vec_id % 5 = 1 AS turned FROM embeddings WHERE len(embedding) > 0 AND list_sum(list_transform(embedding, lambda x: x * x)) > 0),
a AS (SELECT vec_id, turned FROM r WHERE (turned OR vec_id % 7 <> 3 OR vec_id % 35 = 3) AND (vec_id % 35 = 3 OR vec_id % 11 <> 5)) SELECT vec_id, count(*) AS n FROM a GROUP BY 1""")
def lists_after_writes(spark, sf_dir):
    """Each row that should be there is there once."""
    return ann.live(after_writes(spark, sf_dir)[0]).groupBy("vec_id").agg(F.count("*").alias("n"))
