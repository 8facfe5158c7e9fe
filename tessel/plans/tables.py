"""Queries over staged tables: selection, keys, edits, conflicts, dry runs, pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessel.operators import staging as S
from tessel.plans.registry import query, table


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def select_first_n(spark, sf_dir):
    return S.select_rows(table(spark, sf_dir, "orders"), "first_n", 25, "o_orderstatus = 'F'", ["o_totalprice desc", "o_orderkey"]).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_totalprice > 200000 AND o_orderpriority LIKE '1%'")
def select_custom_where(spark, sf_dir):
    return S.select_rows(table(spark, sf_dir, "orders"), "custom", where="o_totalprice > 200000 AND o_orderpriority LIKE '1%'", order_by=["o_orderkey"]).select("o_orderkey", "o_orderpriority")


@query()
def select_random_n(spark, sf_dir):
    return S.select_rows(table(spark, sf_dir, "orders"), "random_n", 50, seed=7).select("o_orderkey")


@query("""SELECT conv_id, turn, '{"conv_id":' || conv_id || ',"turn":' || turn || '}' AS src_key, sha1('{"conv_id":' || conv_id || ',"role":"' || role || '","turn":' || turn || '}') AS row_hash FROM conversations""")
def src_key_hash(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", S.key_json(["turn", "conv_id"]).alias("src_key"), S.row_hash(["turn", "role", "conv_id"]).alias("row_hash"))


def staged(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    return S.stage(c, ["c_custkey"])


@query("""SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS rowid, '{"c_custkey":' || c_custkey || '}' AS key, c_name FROM customer""")
def stage_rows(spark, sf_dir):
    return staged(spark, sf_dir).select(F.col("__rowid").alias("rowid"), F.col("__src_key").alias("key"), "c_name")


def changed(spark, sf_dir):
    """Edits: every fourth name twice (the later one wins), every sixth segment, and a column that the source lacks."""
    own = staged(spark, sf_dir).withColumn("note", F.lit(None).cast("string"))
    edit = lambda cond, col, value, seq: own.where(cond).select(F.col("__rowid").alias("rowid"), F.lit(col).alias("col"), value.alias("value"), F.lit(seq).alias("seq"))
    edits = edit("c_custkey % 4 = 0", "c_name", F.lit("draft"), 1).unionByName(edit("c_custkey % 4 = 0", "c_name", F.concat(F.lit("O'"), "c_name"), 2))
    edits = edits.unionByName(edit("c_custkey % 6 = 0", "c_nationkey", F.lit("7"), 3)).unionByName(edit("c_custkey % 10 = 0", "note", F.lit("seen"), 4))
    return S.edit(own, edits)


_CHANGES = """changes AS (
  SELECT rowid, '{"c_custkey":' || c_custkey || '}' AS key, c_custkey, col, old, new FROM (
    SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS rowid, c_name, c_nationkey FROM customer),
    LATERAL (SELECT * FROM (VALUES ('c_name', c_name, 'O''' || c_name, c_custkey % 4 = 0), ('c_nationkey', c_nationkey::varchar, '7', c_custkey % 6 = 0), ('note', NULL, 'seen', c_custkey % 10 = 0)) t(col, old, new, cond) WHERE cond)
)"""


@query(f"WITH {_CHANGES} SELECT rowid, key, col, old, new FROM changes")
def dirty_changes(spark, sf_dir):
    return S.dirty_changes(*changed(spark, sf_dir))


@query("SELECT count(*) AS total, count(*) FILTER (c_custkey % 4 = 0 OR c_custkey % 6 = 0 OR c_custkey % 10 = 0) AS dirty FROM customer")
def staging_counts(spark, sf_dir):
    return changed(spark, sf_dir)[0].agg(F.count("*").alias("total"), F.count_if(F.col("__dirty") == 1).alias("dirty"))


_SOURCE = ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]


@query(f"""WITH {_CHANGES}, s AS (SELECT *, '"' || col || '" = ' || CASE WHEN col = 'c_nationkey' THEN new ELSE '''' || replace(new, '''', '''''') || '''' END AS set FROM changes WHERE col <> 'note')
SELECT rowid, key, string_agg(col, ',' ORDER BY col) AS columns, 'UPDATE "customer" SET ' || string_agg(set, ', ' ORDER BY col) || ' WHERE "c_custkey" = ' || c_custkey AS statement FROM s GROUP BY rowid, key, c_custkey""")
def dryrun_sql(spark, sf_dir):
    return S.dry_run(S.dirty_changes(*changed(spark, sf_dir)), "customer", {"c_nationkey": "int"}, _SOURCE)


@query("SELECT 'note' AS col WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey % 10 = 0)")
def skipped_columns(spark, sf_dir):
    return S.skipped_columns(S.dirty_changes(*changed(spark, sf_dir)), _SOURCE)


@query(f"WITH {_CHANGES}, r AS (SELECT rowid, string_agg(col, ',' ORDER BY col) AS columns FROM changes GROUP BY rowid) SELECT columns, count(*) AS rows FROM r GROUP BY 1")
def bulk_groups(spark, sf_dir):
    return S.bulk_groups(S.dirty_changes(*changed(spark, sf_dir)))


@query(f"WITH {_CHANGES} SELECT rowid, sum((col = 'note')::int)::bigint AS notes FROM changes WHERE col = 'note' GROUP BY rowid")
def retire_changes(spark, sf_dir):
    """Everything that the source has was written back; what is dirty then is what it lacks."""
    now, old = changed(spark, sf_dir)
    out, left = S.retire(now, old, old.where(F.col("col").isin(*_SOURCE)))
    return out.where("__dirty = 1").select(F.col("__rowid").alias("rowid")).join(left, "rowid").groupBy("rowid").agg(F.count("*").alias("notes"))


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 40 OFFSET 30")
def page_offset(spark, sf_dir):
    return S.page(staged(spark, sf_dir), 40, 30).select("c_custkey", "c_name")


@query("""WITH a AS (SELECT c_custkey AS key, c_name || c_acctbal AS h FROM customer WHERE c_custkey % 19 <> 0),
b AS (SELECT c_custkey AS key, c_name || CASE WHEN c_custkey % 10 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS h FROM customer WHERE c_custkey % 17 <> 0)
SELECT '{"c_custkey":' || coalesce(a.key, b.key) || '}' AS key, CASE WHEN a.h IS NULL THEN 'new' WHEN b.h IS NULL THEN 'deleted' WHEN a.h = b.h THEN 'unchanged' ELSE 'changed' END AS status FROM a FULL JOIN b USING (key)""")
def conflict_diff(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    prints = lambda df: df.select(S.key_json(["c_custkey"]).alias("key"), S.row_hash(df.columns).alias("hash"))
    now = c.where("c_custkey % 17 <> 0").withColumn("c_acctbal", F.when(F.col("c_custkey") % 10 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    return S.conflicts(prints(c.where("c_custkey % 19 <> 0")), prints(now))


@query("SELECT p_partkey, 'p_size = ' || p_size || ', p_name = ''' || replace(p_name, '''', '''''') || '''' AS sets FROM part")
def sql_literals(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("p_size = "), S.literal(F.col("p_size"), "int"), F.lit(", p_name = "), S.literal(F.col("p_name"))).alias("sets"))
