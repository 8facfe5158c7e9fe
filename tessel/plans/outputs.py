"""Queries of batches, write-back plans, research, prompt trees and small lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessel.operators import batch, evals, personas, research
from tessel.operators import lookups as L
from tessel.operators import staging as S
from tessel.plans.registry import query, table
from tessel.plans.tables import _CHANGES, _SOURCE, changed
from tessel.tables import shared_dir


def _items(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    title = F.concat(F.lit(" "), "source", F.lit("/Report: "), F.col("doc_id") % 7, F.lit(" ?."))
    return d.select(F.col("doc_id").alias("pos"), F.when(F.col("doc_id") % 11 == 0, F.lit("..")).otherwise(title).alias("title"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("/in/"), "lang", F.lit(".txt"))).alias("source_path"), F.lit("").alias("chosen_title"), "text")


_PATHS = """i AS (SELECT doc_id AS pos, CASE WHEN doc_id % 3 = 0 THEN 'out-' || lang WHEN doc_id % 11 = 0 THEN 'out-untitled' ELSE 'out-' || source || ' Report ' || (doc_id % 7) END AS s FROM documents),
n AS (SELECT pos, s, row_number() OVER (PARTITION BY s ORDER BY pos) AS k FROM i)"""


@query(f"WITH {_PATHS} SELECT pos, '/o/' || s || CASE WHEN k = 1 THEN '' ELSE ' (' || k || ')' END || '.md' AS path FROM n")
def output_paths(spark, sf_dir):
    return batch.output_paths(_items(spark, sf_dir), output_dir="/o/", prefix=" out- ", ext="md").select("pos", "path")


@query(r"""SELECT doc_id AS pos, '# ' || CASE WHEN doc_id % 11 = 0 THEN '..' ELSE ' ' || source || '/Report: ' || (doc_id % 7) || ' ?.' END || chr(10) || chr(10) ||
 '# Source: ' || CASE WHEN doc_id % 11 = 0 THEN '..' ELSE ' ' || source || '/Report: ' || (doc_id % 7) || ' ?.' END || CASE WHEN doc_id % 3 = 0 THEN chr(10) || '/in/' || lang || '.txt' ELSE '' END || chr(10) || chr(10) || coalesce(text, '')
 || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '# Prompt' || chr(10) || chr(10) || 'p' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '# Response' || chr(10) || chr(10) || coalesce(text, '') AS text FROM documents""")
def combined_parts(spark, sf_dir):
    own = _items(spark, sf_dir).withColumn("body", batch.body(F.col("title"), F.col("source_path"), F.col("text"), F.lit("p"), F.col("text"), True, True))
    return batch.combined(own)


@query("SELECT event_id AS seq, event_type AS status FROM events ORDER BY seq DESC LIMIT 200 OFFSET 50")
def audit_page(spark, sf_dir):
    """A log that is written in two steps, with lines that are no JSON, and read newest first."""
    path = f"{shared_dir(spark)}/audit"
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("status"))
    batch.append_audit(e.where("seq % 2 = 0"), path)
    batch.append_audit(e.where("seq % 2 = 1"), path)
    e.where("seq % 100 = 0").select(F.lit("{broken").alias("value")).write.mode("append").text(path)
    return batch.read_audit(spark, path, "seq long, status string", 200, 50)


@query("SELECT least(count(*), 500)::bigint AS n FROM orders WHERE o_totalprice > 200000")
def count_selection(spark, sf_dir):
    return S.count_rows(table(spark, sf_dir, "orders"), "first_n", 500, "o_totalprice > 200000")


@query("""WITH a AS (SELECT c_custkey AS key, c_name AS h FROM customer WHERE c_custkey % 3 = 0), b AS (SELECT c_custkey AS key, c_name || CASE WHEN c_custkey % 10 = 0 THEN '!' ELSE '' END AS h FROM customer WHERE c_custkey % 17 <> 0)
SELECT '{"c_custkey":' || a.key || '}' AS key, CASE WHEN b.h IS NULL THEN 'deleted' WHEN a.h = b.h THEN 'unchanged' ELSE 'changed' END AS status FROM a LEFT JOIN b USING (key)""")
def sampled_conflicts(spark, sf_dir):
    """A sample was staged: just its keys are read again, and rows that are new to the source are no matter."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    staged = S.stage(c.where("c_custkey % 3 = 0"), ["c_custkey"])
    now = c.where("c_custkey % 17 <> 0").withColumn("c_name", F.concat("c_name", F.when(F.col("c_custkey") % 10 == 0, "!").otherwise("")))
    return S.conflicts(staged.select(F.col("__src_key").alias("key"), F.col("__row_hash").alias("hash")), S.current_hashes(now, staged, ["c_custkey"], ["c_custkey", "c_name"], False), True)


@query(f"WITH {_CHANGES}, k AS (SELECT *, row_number() OVER (PARTITION BY rowid ORDER BY col) AS k FROM changes WHERE col <> 'note') SELECT rowid, col, new FROM k WHERE k <= 1")
def capped_changes(spark, sf_dir):
    return S.capped_changes(S.dirty_changes(*changed(spark, sf_dir)), _SOURCE, 1).select("rowid", "col", "new")


@query(f"WITH {_CHANGES} SELECT key, col, new FROM changes WHERE col <> 'note' AND c_custkey % 5 <> 0")
def write_plan(spark, sf_dir):
    """Every fifth row has changed in the source or is gone: they are skipped."""
    k = F.col("c_custkey")
    found = table(spark, sf_dir, "customer").select(F.concat(F.lit('{"c_custkey":'), k, F.lit("}")).alias("key"), F.when(k % 10 == 0, "changed").when(k % 5 == 0, "deleted").otherwise("unchanged").alias("status"))
    return S.plan_write_back(S.dirty_changes(*changed(spark, sf_dir)), _SOURCE, ["c_custkey"], found, True, "skip").select("key", "col", "new")


@query("""WITH r AS (SELECT page_id, url, page_id % 40 AS query FROM pages UNION ALL SELECT page_id + 100000, url, page_id % 40 FROM pages WHERE page_id % 3 = 0),
u AS (SELECT *, row_number() OVER (PARTITION BY query, url ORDER BY page_id) AS k FROM r WHERE starts_with(url, 'http'))
SELECT query, url, row_number() OVER (PARTITION BY query ORDER BY page_id) - 1 AS rank FROM u WHERE k = 1 QUALIFY rank < 30""")
def search_results(spark, sf_dir):
    return _results(spark, sf_dir).select("query", "url", "rank")


def _results(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select((F.col("page_id") % 40).alias("query"), F.col("page_id").alias("pos"), "url", F.lit("<b>T</b> &amp; ").alias("title"), F.lit("").alias("description"), F.array(F.lit(" <i>s</i> "), F.lit(None)).alias("snippets"))
    return research.results(p.unionByName(p.where("pos % 3 = 0").withColumn("pos", F.col("pos") + 100000)))


@query()
def research_blocks(spark, sf_dir):
    """Pages are read by the extractor: held against plain Python in the tests."""
    return research.research_block(research.crawled(_results(spark, sf_dir), table(spark, sf_dir, "pages").select("url", "html"), 7), 7)


@query("SELECT c_custkey AS chat, s AS id FROM customer, (SELECT DISTINCT source AS s FROM documents) WHERE s IN ('src' || (c_custkey % 20), 'src' || ((c_custkey + 5) % 20))")
def selected_libraries(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("chat"), F.array(F.concat(F.lit("src"), F.col("c_custkey") % 20), F.concat(F.lit("src"), (F.col("c_custkey") + 5) % 20), F.lit("gone")).alias("library_ids"))
    libraries = table(spark, sf_dir, "documents").select(F.col("source").alias("id")).distinct().withColumn("pos", F.col("id"))
    return L.selected(libraries, c).select("chat", "id")


@query(r"""SELECT CASE WHEN doc_id % 2 = 0 THEN doc_id::varchar ELSE source || ':' || doc_id END AS item_id, CASE WHEN doc_id % 3 = 0 THEN 'L' || doc_id WHEN doc_id % 3 = 1 THEN lang || '.txt' ELSE 'Write' END AS label, regexp_replace(text, '^\s+|\s+$', '', 'g') AS content
FROM documents WHERE regexp_matches(text, '\S')""")
def enumerated_items(spark, sf_dir):
    k = F.col("doc_id") % 3
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("library"), F.col("doc_id").alias("pos"), F.when(F.col("doc_id") % 2 == 0, F.col("doc_id").cast("string")).alias("id"), F.when(k == 0, F.concat(F.lit("L"), "doc_id")).otherwise("").alias("label"), F.when(k == 1, F.concat("lang", F.lit(".txt"))).alias("filename"), F.lit("write").alias("type"), F.col("text").alias("content"))
    return L.enumerated(d).select("item_id", "label", "content")


@query("SELECT conv_id AS chat FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 3 <> 0 AND conv_id % 7 <> 0")
def eligible_chats(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("chat")).distinct()
    chats = c.withColumns({"private": F.col("chat") % 3 == 0, "created": F.col("chat").cast("string")})
    return L.eligible(chats, c.where("chat % 7 = 0")).select("chat")


@query("""WITH e AS (SELECT c_custkey AS seq, c_nationkey::varchar AS core, c_custkey % 4 AS k FROM customer)
SELECT seq, CASE WHEN core = '7' THEN 'core' WHEN k = 1 THEN 'gone' WHEN k = 2 THEN 'text' ELSE 'saved' END AS outcome FROM e""")
def memory_edits(spark, sf_dir):
    """Edits of entries that are there, that are gone, new ones without a text, and new ones; one core is unknown."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("seq"), F.col("c_nationkey").cast("string").alias("core"))
    entries = c.select("core", F.col("seq").cast("string").alias("id"), F.lit("facts").alias("category"), F.lit("t").alias("text"), F.lit(5).alias("importance"), F.lit(False).alias("pinned"), F.lit("ai").alias("origin"), F.lit("1").alias("created"))
    k = F.col("seq") % 4
    edits = c.select("seq", "core", F.when(k == 0, F.col("seq").cast("string")).when(k == 1, F.concat(F.lit("x"), "seq")).alias("id"), F.when(k == 2, " ").otherwise("new words").alias("text"))
    return L.edited_memories(entries, entries.select("core").distinct().where("core <> '7'"), edits)[1]


@query("SELECT p_partkey AS pos, 'system' AS kind, p_brand AS \"group\", p_type AS category FROM part WHERE p_brand = (SELECT min(p_brand) FROM part)")
def prompt_slice(spark, sf_dir):
    """A tree that is written as XML, read back, and of which one group is taken."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("group"), F.col("p_type").alias("category"), F.concat(F.lit('n"<'), F.col("p_partkey")).alias("name"), F.concat("p_name", F.lit(" & <x>")).alias("prompt"), F.col("p_partkey").alias("pos"))
    path = f"{shared_dir(spark)}/prompts"
    personas.write_tree(p, "system", path)
    tree = personas.read_tree(spark, path)
    first = table(spark, sf_dir, "part").agg(F.min("p_brand")).first()[0]
    return personas.slice_tree(tree, "other", first).select(F.expr("cast(substr(name, 4) as long)").alias("pos"), "kind", "group", "category")


@query("""SELECT doc_id, 'Judge: ' || text || ' | ' || lang || ' again ' || lang || '!' AS prompt FROM documents""")
def evaluation_prompts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", evals.evaluation_prompt(F.lit("Judge: [Input Prompt] | [response] again [RESPONSE]!"), F.col("text"), F.col("lang")).alias("prompt"))


@query(r"""SELECT doc_id, array_to_string(list_transform(string_split('TASK' || chr(10) || text || chr(10) || '== FAKE ==', chr(10)), lambda x: CASE WHEN regexp_matches(x, '^\s*={2,}.*={2,}\s*$') THEN replace(x, '=', '-') ELSE x END), chr(10)) AS safe FROM documents""")
def grader_prompts(spark, sf_dir):
    """The task within a grader's prompt, with a line that looks like a section of it."""
    task = F.concat(F.lit("TASK\n"), "text", F.lit("\n== FAKE =="))
    prompt = evals.grader_prompt(task, F.lit("answer"), [{"label": "tone", "min": 0, "max": 5}, {"label": "why", "mode": "reasoning"}])
    inner = F.regexp_extract(prompt, r"(?s)=== TASK GIVEN TO THE MODEL ===\n(.*)\n\n=== RESPONSE TO GRADE ===\nanswer\n\n=== EVALUATION", 1)
    return table(spark, sf_dir, "documents").select("doc_id", inner.alias("safe"))
