"""Queries of merging profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessel.operators import profiles as P
from tessel.plans.registry import query, table


def _sets(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.concat(F.lit("n"), F.col("c_custkey") % 50).alias("name"), F.col("c_custkey").alias("pos"))
    return c.where("pos % 2 = 0"), c.where("pos % 3 = 0")


@query("""SELECT c_custkey AS pos, c_custkey % 6 = 0 AS fresh FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, false FROM customer WHERE c_custkey % 2 = 0""")
def append_fresh(spark, sf_dir):
    return P.append_fresh(*_sets(spark, sf_dir)).select("pos", (F.col("id") != F.col("pos").cast("string")).alias("fresh"))


@query("""WITH n AS (SELECT c_custkey AS pos, 'n' || (c_custkey % 50) AS name, row_number() OVER (PARTITION BY c_custkey % 50 ORDER BY c_custkey) AS k FROM customer WHERE c_custkey % 3 = 0)
SELECT pos, CASE WHEN name IN (SELECT 'n' || (c_custkey % 50) FROM customer WHERE c_custkey % 2 = 0) THEN name || ' (imported)' || CASE WHEN k > 1 THEN ' ' || k ELSE '' END ELSE name END AS name FROM n""")
def imported_names(spark, sf_dir):
    return P.imported(*_sets(spark, sf_dir)).select("pos", "name")


@query("SELECT c_custkey::varchar AS id, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE 'old' END AS origin FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0")
def upsert_rows(spark, sf_dir):
    old, new = _sets(spark, sf_dir)
    return P.upsert(old.select("id", F.lit("old").alias("origin")), new.select("id", F.lit("new").alias("origin")))


@query("SELECT c_custkey AS chat FROM customer WHERE c_nationkey <> 7")
def delete_group(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("chat"), F.col("c_nationkey").cast("string").alias("group_id"))
    groups = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("id"))
    return P.delete_group(groups, c, "7")[1].select("chat")


@query("""SELECT conv_id AS chat, '{"chat":' || conv_id || ',"turns":' || count(*) || ',"private":false}' AS json FROM conversations GROUP BY conv_id""")
def chat_envelopes(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("chat")).agg(F.count("*").alias("turns"), F.lit("g").alias("group_id"), F.lit(True).alias("private"))
    return P.envelope(c)
