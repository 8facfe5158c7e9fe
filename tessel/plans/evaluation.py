"""Queries of evaluation: grades, breakdowns, sweeps, prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessel.functions.text import fill, render, score_class
from tessel.operators import evals
from tessel.plans.registry import query, table

_MODES = "('quality', 'score', 0, 1), ('toxic', 'score', 0, 4)"


def grades(spark, sf_dir):
    """Two criteria of each labelled document as a grader's replies, read back by the tolerant parser; some are missing."""
    own = table(spark, sf_dir, "labels")
    reply = F.when(F.col("doc_id") % 13 == 0, F.lit("no idea")).otherwise(
        F.concat(F.lit('Here you are: {"Quality": {"score": "'), "quality", F.lit(' points", "reasoning": "r{}"}, "toxic": '), F.col("toxic") * 9 - 2, F.lit("} bye"))
    )
    replies = own.select(F.concat(F.lit("m"), F.col("doc_id") % 3).alias("model"), F.col("doc_id").alias("row"), reply.alias("reply"))
    criteria = spark.createDataFrame([("quality", "score", "0", "1"), ("toxic", "score", "0", "4"), ("note", "reasoning", None, None)], "label string, mode string, min string, max string")
    return evals.normalise_grades(replies, criteria)


_GRADES = """g AS (
  SELECT 'm' || (doc_id % 3) AS model, doc_id AS row, 'quality' AS label, 0.0::double AS lo, 1.0::double AS hi, CASE WHEN doc_id % 13 <> 0 THEN quality::double END AS score FROM labels
  UNION ALL SELECT 'm' || (doc_id % 3), doc_id, 'toxic', 0.0, 4.0, CASE WHEN doc_id % 13 <> 0 THEN (toxic * 9 - 2)::double END FROM labels
), b AS (
  SELECT model, label, round(avg(least(greatest(score, lo), hi)), 2) AS avg, round(avg(least(greatest(score / hi, 0), 1) * 100), 1) AS percent, count(*) AS n FROM g WHERE score IS NOT NULL GROUP BY ALL
)"""


@query(f"WITH {_GRADES} SELECT model, label, avg, percent, n FROM b")
def eval_breakdown(spark, sf_dir):
    return evals.breakdown(grades(spark, sf_dir))


@query(f"""WITH {_GRADES}, rows AS (SELECT model, row, bool_or(score IS NOT NULL) AS ok FROM g GROUP BY ALL),
r AS (SELECT model, count(*) FILTER (ok) AS graded, count(*) AS total FROM rows GROUP BY 1), o AS (SELECT model, round(avg(percent), 1) AS overall FROM b GROUP BY 1)
SELECT model, overall, graded, total FROM r LEFT JOIN o USING (model)""")
def eval_aggregate(spark, sf_dir):
    return evals.aggregate(grades(spark, sf_dir))


@query(f"WITH {_GRADES} SELECT model, max(percent) FILTER (label = 'quality') AS quality, max(percent) FILTER (label = 'toxic') AS toxic FROM b GROUP BY model")
def eval_breakdown_pivot(spark, sf_dir):
    return evals.pivoted(grades(spark, sf_dir), ["quality", "toxic"])


@query("SELECT item_id, m AS model FROM benchmark, (VALUES ('small'), ('large'), ('other')) t(m)")
def model_sweep(spark, sf_dir):
    return evals.sweep(table(spark, sf_dir, "benchmark").select("item_id"), ["small", "large", "other"])


@query("SELECT c_custkey, 'Dear ' || c_name || ' of {Nowhere}, segment ' || c_mktsegment || ', {c_name} again: ' || c_name AS prompt FROM customer")
def fill_prompt(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("segment", F.concat("c_mktsegment", F.lit(", {c_name} again")))
    return c.select("c_custkey", fill(F.lit("Dear {c_name} of {Nowhere}, segment {segment}: {c_name}"), {"c_name": F.col("c_name"), "segment": F.col("segment")}).alias("prompt"))


@query("SELECT page_id, 'Page ' || url || chr(10) || chr(10) || html AS prompt FROM pages")
def render_item_prompt(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", render(F.lit("Page {{ URL }}"), {"url": F.col("url"), "content": F.col("html")}).alias("prompt"))


@query("SELECT doc_id, CASE WHEN n_chars % 101 >= 75 THEN 'good' WHEN n_chars % 101 >= 50 THEN 'ok' ELSE 'bad' END AS grade FROM documents")
def score_classes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", score_class(F.col("n_chars") % 101).alias("grade"))
