"""Queries over chunked documents and embeddings: chunking, keyword, vector and hybrid search, fusion, provenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessel.functions.text import content_hash, summary, terms
from tessel.operators import retrieval as R
from tessel.plans.registry import query, table

#: Who asks: every twentieth vector of the table itself, and every twentieth benchmark text.
ASK_VECTORS, ASK_TEXTS = "SELECT vec_id AS query, embedding FROM embeddings WHERE vec_id % 20 = 0", "SELECT item_id AS query, text AS q FROM benchmark WHERE item_id % 20 = 0"

#: Windows of 200 words, 40 shared.
CHUNKS_SQL = r"""
items AS (
  SELECT source AS source_id, doc_id::varchar AS item_id,
         list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents
), spread AS (
  SELECT *, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) <= 200 THEN [0] ELSE range(0, ceil((len(w) - 200) / 160.0)::int + 1) END)::int AS chunk_index FROM items
), chunks AS (
  SELECT 'library:' || source_id || ':' || item_id || ':' || chunk_index AS id, 'library' AS source_type, source_id, item_id, chunk_index,
         array_to_string(w[chunk_index * 160 + 1 : chunk_index * 160 + 200], ' ') AS content FROM spread
)"""


def chunks(spark, sf_dir):
    return R.chunk(table(spark, sf_dir, "documents"), "library", "source", "doc_id", "text")


def bm25_sql(asked: str, corpus: str, key: str, k: int, tail: str) -> str:
    """asked: SQL of (query, q); corpus: SQL of (key, text)."""
    return rf"""
asked AS (SELECT DISTINCT query, unnest(regexp_extract_all(lower(q), '[a-z0-9]+')) AS term FROM ({asked})),
own AS (SELECT {key}, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM ({corpus})),
totals AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM own),
postings AS (
  SELECT {key}, dl, term, count(*) AS tf FROM (SELECT {key}, len(t) AS dl, unnest(t) AS term FROM own)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), df AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
scored AS (
  SELECT query, {key}, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM postings JOIN df USING (term) JOIN asked USING (term), totals GROUP BY ALL HAVING score > 0
), keyword AS (
  SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, {key}) - 1 AS rank FROM scored QUALIFY rank < {k}
){tail}"""


_CORPUS = "SELECT id, content AS text FROM chunks"


@query("WITH " + CHUNKS_SQL + " SELECT id, source_id, item_id, chunk_index, content, sha1(content) AS content_hash FROM chunks")
def chunk_word_window(spark, sf_dir):
    return chunks(spark, sf_dir).select("id", "source_id", "item_id", "chunk_index", "content", "content_hash")


@query("SELECT doc_id, sha1(coalesce(text, '')) AS content_hash, sha256(coalesce(source, '') || chr(1) || coalesce(text, ''))[1:40] AS item_key FROM documents")
def chunk_hash(spark, sf_dir):
    key = F.substring(F.sha2(F.concat(F.coalesce("source", F.lit("")), F.lit("\x01"), F.coalesce("text", F.lit(""))), 256), 1, 40)
    return table(spark, sf_dir, "documents").select("doc_id", content_hash("text").alias("content_hash"), key.alias("item_key"))


@query(r"SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')[1:120], ' ') AS summary FROM documents")
def doc_summary(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", summary("text").alias("summary"))


@query("SELECT term, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents) GROUP BY term")
def tokenize_terms(spark, sf_dir):
    each = table(spark, sf_dir, "documents").select("doc_id", F.explode(terms("text")).alias("term")).groupBy("term", "doc_id").agg(F.count("*").alias("k"))
    return each.groupBy("term").agg(F.sum("k").alias("n"), F.count("*").alias("docs"))


def texts(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").where("item_id % 20 = 0").select(F.col("item_id").alias("query"), F.col("text").alias("q"))


@query("WITH " + CHUNKS_SQL + "," + bm25_sql(ASK_TEXTS, _CORPUS, "id", 10, "") + " SELECT query, id, round(score, 6) AS score, rank, split_part(id, ':', 2) AS source, split_part(id, ':', -1)::int AS place FROM keyword")
def bm25_topk(spark, sf_dir):
    found = R.bm25(chunks(spark, sf_dir), texts(spark, sf_dir), 10)
    return R.describe(found).select("query", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"), "source", "place")


@query("WITH " + CHUNKS_SQL + "," + bm25_sql("SELECT query * 2 + k AS query, CASE k WHEN 0 THEN q ELSE upper(q) || ' scum' END AS q FROM (" + ASK_TEXTS + "), (VALUES (0), (1)) t(k)", _CORPUS, "id", 20, "") + " SELECT query, id, round(score, 6) AS score, rank FROM keyword")
def bm25_multi_query(spark, sf_dir):
    """Two variants of each question."""
    two = texts(spark, sf_dir).select(F.col("query") * 2 + F.lit(0), "q").toDF("query", "q").unionByName(texts(spark, sf_dir).select((F.col("query") * 2 + 1).alias("query"), F.concat(F.upper("q"), F.lit(" scum")).alias("q")))
    return R.bm25(chunks(spark, sf_dir), two, 20).select("query", "id", F.round("score", 6).alias("score"), "rank")


@query("WITH " + bm25_sql("SELECT item_id AS query, text AS q FROM benchmark WHERE item_id % 20 = 0", "SELECT doc_id, text FROM documents", "doc_id", 5, "") + " SELECT query, doc_id, round(score, 6) AS score, rank FROM keyword")
def bm25_benchmark(spark, sf_dir):
    found = R.bm25(table(spark, sf_dir, "documents"), texts(spark, sf_dir), 5, "doc_id", F.col("text"))
    return found.select("query", "doc_id", F.round("score", 6).alias("score"), "rank")


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), "embedding")


_COS = "list_cosine_similarity(e.embedding::double[], q.embedding::double[])"


def vector_sql(k: int, rows: str = "embeddings", score: str = _COS, where: str = "true") -> str:
    return f"""
asked_v AS ({ASK_VECTORS}),
near AS (SELECT q.query, e.vec_id, {score} AS score FROM {rows} e, asked_v q WHERE {where}),
vector AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, vec_id) - 1 AS rank FROM near QUALIFY rank < {k})"""


@query(f"WITH {vector_sql(20)} SELECT query, vec_id, round(score, 6) AS score, rank FROM vector")
def cosine_topk(spark, sf_dir):
    return R.vector_search(table(spark, sf_dir, "embeddings"), vectors(spark, sf_dir), 20, "vec_id").select("query", "vec_id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {vector_sql(15, where='e.label IN (1, 2, 3) AND e.vec_id % 2 = 0')} SELECT query, vec_id, round(score, 6) AS score, rank FROM vector")
def cosine_model_scope(spark, sf_dir):
    own = table(spark, sf_dir, "embeddings").withColumns({"model": F.concat(F.lit("m"), F.col("vec_id") % 2), "source_type": F.lit("library"), "source_id": F.col("label").cast("string")})
    inside = R.in_scope(own, "library", ["1", "2", "3"], "m0")
    return R.vector_search(inside, vectors(spark, sf_dir), 15, "vec_id").select("query", "vec_id", F.round("score", 6).alias("score"), "rank")


#: Hybrid rows: vectors with the text of the document of the same id; each question has the vector and the first turn of a
#: conversation of its number.
_HYBRID = "SELECT e.vec_id, d.text FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id"
_TURNS = "SELECT conv_id AS query, arg_min(text, turn) AS q FROM conversations WHERE conv_id % 20 = 0 GROUP BY 1"
_FUSE = "sum(1.0::double / (60 + rank + 1)) AS score, min(struct_pack(list := list, rank := rank)) AS first"


def turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("conv_id % 20 = 0").groupBy(F.col("conv_id").alias("query")).agg(F.min_by("text", "turn").alias("q"))


@query(f"""
WITH {vector_sql(12, '(SELECT * FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents))')},
{bm25_sql(_TURNS, _HYBRID, 'vec_id', 12, '')},
lists AS (SELECT query, 0 AS list, vec_id, rank FROM vector UNION ALL SELECT query, 1, vec_id, rank FROM keyword),
fused AS (SELECT query, vec_id, {_FUSE} FROM lists GROUP BY query, vec_id),
numbered AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, first) - 1 AS rank FROM fused QUALIFY rank < 12)
SELECT query, vec_id, round(score, 6) AS score, rank FROM numbered""")
def hybrid_rrf(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), F.col("text").alias("content"))
    rows = table(spark, sf_dir, "embeddings").join(docs, "vec_id").withColumn("model", F.lit("m"))
    return R.hybrid(rows, turns(spark, sf_dir), vectors(spark, sf_dir), "m", 12, "vec_id").select("query", "vec_id", F.round("score", 6).alias("score"), "rank")


@query(f"""
WITH {", ".join(f"w{c} AS (WITH {vector_sql(10, where=f'e.label % 3 = {c}')} SELECT query, vec_id, rank, {c} AS list FROM vector)" for c in range(3))},
lists AS (SELECT * FROM w0 UNION ALL SELECT * FROM w1 UNION ALL SELECT * FROM w2), n AS (SELECT query, count(DISTINCT list) AS n FROM lists GROUP BY 1),
fused AS (SELECT query, vec_id, {_FUSE} FROM lists GROUP BY query, vec_id),
numbered AS (SELECT f.*, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, first) - 1 AS rank, CASE WHEN n <= 1 THEN 5 ELSE least(5 + 2 * (n - 1), 15) END AS room FROM fused f JOIN n USING (query))
SELECT query, vec_id, round(score, 6) AS score, rank FROM numbered WHERE rank < room""")
def fuse_corpora(spark, sf_dir):
    """Three corpora by label; scores do not compare, ranks do."""
    have = table(spark, sf_dir, "embeddings").withColumn("source_id", F.col("label") % 3)
    lists = [R.vector_search(have.where(F.col("source_id") == c), vectors(spark, sf_dir), 10, "vec_id").withColumn("source_id", F.lit(c)) for c in range(3)]
    return R.fuse_lists(lists[0].unionByName(lists[1]).unionByName(lists[2]), 5, "vec_id").select("query", "vec_id", F.round("score", 6).alias("score"), "rank")


@query(f"""
WITH {vector_sql(18)}, weighed AS (SELECT query, vec_id, greatest(score, 0) * (1 + 0.35 * ((vec_id % 10 + 1) - 5) / 5) AS score FROM vector),
numbered AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, vec_id) - 1 AS rank FROM weighed QUALIFY rank < 6)
SELECT query, vec_id, round(score, 6) AS score, rank FROM numbered""")
def memory_weight_rerank(spark, sf_dir):
    own = table(spark, sf_dir, "embeddings").withColumn("meta", F.to_json(F.struct((F.col("vec_id") % 10 + 1).alias("weight"))))
    return R.memory_search(own, vectors(spark, sf_dir), 6, "vec_id").select("query", "vec_id", F.round("score", 6).alias("score"), "rank")


@query("WITH " + CHUNKS_SQL + " SELECT source_type, source_id, count(*) AS n FROM chunks GROUP BY ALL")
def count_scope(spark, sf_dir):
    from tessel.operators.index import count_scope as count

    return count(chunks(spark, sf_dir))


@query("WITH " + CHUNKS_SQL + " SELECT source_type, source_id, item_id, count(*) AS chunks FROM chunks GROUP BY ALL")
def list_items(spark, sf_dir):
    from tessel.operators.index import list_items as items

    return items(chunks(spark, sf_dir))


@query("WITH " + CHUNKS_SQL + " SELECT source_type, source_id, item_id, string_agg(sha1(content), ',' ORDER BY chunk_index) AS hashes FROM chunks GROUP BY ALL")
def ordered_hashes(spark, sf_dir):
    from tessel.operators.index import ordered_hashes as hashes

    return hashes(chunks(spark, sf_dir)).withColumn("hashes", F.array_join("hashes", ","))


@query("WITH " + CHUNKS_SQL + "," + bm25_sql(ASK_TEXTS, _CORPUS, "id", 20, "") + " SELECT query, id, round(score, 6) AS score, rank FROM keyword")
def bm25_postings(spark, sf_dir):
    """The same search over a persisted index, which is written first and then read."""
    from tessel.operators import postings
    from tessel.tables import shared_dir

    path = shared_dir(spark)
    postings.write(*postings.build(chunks(spark, sf_dir)), path)
    return postings.search(*postings.read(spark, path), texts(spark, sf_dir), 20).select("query", "id", F.round("score", 6).alias("score"), "rank")


_BY_SOURCE = """
asked AS (SELECT DISTINCT query, unnest(regexp_extract_all(lower(q), '[a-z0-9]+')) AS term FROM ({0})),
own AS (SELECT source_id, id, regexp_extract_all(lower(content), '[a-z0-9]+') AS t FROM chunks),
totals AS (SELECT source_id, count(*) AS n, avg(len(t)) AS avgdl FROM own GROUP BY 1),
postings AS (SELECT source_id, id, dl, term, count(*) AS tf FROM (SELECT source_id, id, len(t) AS dl, unnest(t) AS term FROM own) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
df AS (SELECT source_id, term, count(*) AS df FROM postings GROUP BY ALL),
scored AS (SELECT query, source_id, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM postings JOIN df USING (source_id, term) JOIN asked USING (term) JOIN totals USING (source_id) GROUP BY ALL HAVING score > 0),
lists AS (SELECT query, source_id AS list, id, row_number() OVER (PARTITION BY query, source_id ORDER BY round(score, 9) DESC, id) - 1 AS rank FROM scored
  WHERE {1} QUALIFY rank < 4),
fused AS (SELECT query, id, sum(1.0::double / (60 + rank + 1)) AS score, min(struct_pack(list := list, rank := rank)) AS first FROM lists GROUP BY query, id),
room AS (SELECT query, CASE WHEN count(DISTINCT list) <= 1 THEN 4 ELSE least(4 + 2 * (count(DISTINCT list) - 1), 12) END AS room FROM lists GROUP BY 1),
numbered AS (SELECT f.*, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, first) - 1 AS rank, room FROM fused f JOIN room USING (query)),
found AS (SELECT query, rank, id, score, split_part(id, ':', 2) AS source_id, split_part(id, ':', 3) AS item_id FROM numbered WHERE rank < room)"""
#: A question searches three libraries, of which those that end in 7 were never compiled.
_CHOSEN = "source_id IN ('src' || (query % 20), 'src' || ((query + 7) % 20), 'src' || ((query + 12) % 20)) AND NOT source_id LIKE '%7'"


def found_for_chats(spark, sf_dir):
    from tessel.operators import answers

    asked = texts(spark, sf_dir).withColumn("library_ids", F.array(*[F.concat(F.lit("src"), (F.col("query") + k) % 20) for k in (0, 7, 12)]))
    states = table(spark, sf_dir, "documents").select(F.col("source").alias("source_id")).distinct().withColumn("state", F.when(F.col("source_id").endswith("7"), "none").otherwise("compiled"))
    return answers.retrieve_for(asked, chunks(spark, sf_dir), states, 4)


@query("WITH " + CHUNKS_SQL + "," + _BY_SOURCE.format(ASK_TEXTS, _CHOSEN) + " SELECT query, rank, id, round(score, 6) AS score FROM found")
def retrieve_for_chats(spark, sf_dir):
    """Each question over its own compiled libraries, each with its own statistics, fused by rank."""
    return found_for_chats(spark, sf_dir).select("query", "rank", "id", F.round("score", 6).alias("score"))


_LIVE = "CASE WHEN item_id::bigint % 2 = 0 THEN 'live ' || item_id WHEN item_id::bigint % 3 = 0 THEN 'kept ' || item_id ELSE item_id END"


def described(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("item_id"), F.col("source").alias("source_id"))
    rows = found_for_chats(spark, sf_dir).withColumn("meta", F.when(F.col("item_id").cast("long") % 3 == 0, F.to_json(F.struct(F.concat(F.lit("kept "), "item_id").alias("label")))))
    names = d.select("source_id").distinct().where("source_id <> 'src3'").withColumn("name", F.upper("source_id"))
    return R.sources(rows, d.where("item_id % 2 = 0").select("item_id", F.concat(F.lit("live "), "item_id").alias("live_label")), names)


@query("WITH " + CHUNKS_SQL + "," + _BY_SOURCE.format(ASK_TEXTS, _CHOSEN) + f""" SELECT query, rank, 'library' AS kind, source_id, item_id, split_part(id, ':', 4)::int AS chunk_index, {_LIVE} AS label,
  CASE WHEN source_id = 'src3' THEN '' ELSE upper(source_id) END AS library_name FROM found""")
def source_rows(spark, sf_dir):
    return described(spark, sf_dir).select("query", "rank", "kind", "source_id", "item_id", "chunk_index", "label", "library_name")


_ESC = "replace(replace(replace(content, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query("WITH " + CHUNKS_SQL + "," + _BY_SOURCE.format(ASK_TEXTS, _CHOSEN) + f""", b AS (SELECT f.*, c.content, {_LIVE.replace('item_id', 'f.item_id')} AS label FROM found f JOIN chunks c ON c.id = f.id)
SELECT query, '<retrieved>' || chr(10) || string_agg('  <excerpt item="' || item_id || '" label="' || label || '" score="' || printf('%.3f', score) || '">' || chr(10) || {_ESC} || chr(10) || '  </excerpt>', chr(10) ORDER BY rank) || chr(10) || '</retrieved>' AS block FROM b GROUP BY query""")
def excerpt_blocks(spark, sf_dir):
    return R.excerpt_block(described(spark, sf_dir))


@query("WITH " + CHUNKS_SQL + "," + _BY_SOURCE.format(ASK_TEXTS, _CHOSEN) + """, b AS (SELECT f.*, c.content FROM found f JOIN chunks c ON c.id = f.id)
SELECT query, string_agg('[' || (rank + 1) || '] (' || item_id || ') ' || content, chr(10) || chr(10) ORDER BY rank) AS excerpts FROM b GROUP BY query""")
def plain_excerpts(spark, sf_dir):
    return R.excerpts(found_for_chats(spark, sf_dir), ["query"])


@query("WITH " + CHUNKS_SQL + "," + bm25_sql(ASK_TEXTS, _CORPUS, "id", 20, "") + " SELECT query, id, round(score, 6) AS score, rank FROM keyword")
def bm25_blocks(spark, sf_dir):
    """The same ranks from a written index by impact, of which only blocks are read that can still matter."""
    from tessel.operators import postings
    from tessel.tables import shared_dir

    path = f"{shared_dir(spark)}/blocks"
    own = chunks(spark, sf_dir)
    postings.write_blocks(postings.blocks_of(postings.counted(own), postings.totals_of(own)), path)
    found, _ = postings.search_blocks(postings.read_blocks(spark, path), texts(spark, sf_dir), 20)
    return found.select("query", "id", F.round("score", 6).alias("score"), "rank")
