"""From a question to what a model is told: rewritten queries, retrieval over a chat's own corpora, context blocks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessel.functions.text import strip
from tessel.operators.evals import complete, parse_reply
from tessel.operators.retrieval import HELD, bm25, fuse_lists
from tessel.tables import saved, shared_dir

VARIANTS, TURNS, HISTORY_CHARS = 3, 6, 1500
#: Fixed value: what the rewriting model is told.
REWRITE = (
    "You rewrite a user's chat message into search queries for retrieving relevant passages from a knowledge base. Resolve pronouns and vague references using the "
    "conversation so far. Produce 2-3 diverse, self-contained query variants and a short list of important keywords. Respond ONLY with JSON of the form "
    '{"queries": ["...", "..."], "keywords": ["...", "..."]}.'
)


def history(messages: DataFrame, turns: int = TURNS, chars: int = HISTORY_CHARS) -> DataFrame:
    """(chat, history): the last shown turns of a chat before the message that ends it, one line each, and of that text the
    last `chars` characters. A last turn of the user is the message itself and left out."""
    shown = messages.where(F.col("role").isin("user", "assistant") & ~F.coalesce(F.col("intermediate"), F.lit(False)))
    k = F.row_number().over(Window.partitionBy("chat").orderBy(F.desc("idx")))
    last = F.max_by("role", "idx").over(Window.partitionBy("chat"))
    own = shown.withColumns({"k": k, "last": last}).withColumn("k", F.col("k") - (F.col("last") == "user").cast("int")).where((F.col("k") >= 1) & (F.col("k") <= turns))
    text = F.replace(strip(F.coalesce("content", F.lit(""))), F.lit("\n"), F.lit(" "))
    line = F.when(text != "", F.concat(F.when(F.col("role") == "user", "User: ").otherwise("Assistant: "), text))
    lines = F.transform(F.array_sort(F.collect_list(F.when(line.isNotNull(), F.struct("idx", line.alias("line"))))), lambda x: x["line"])
    joined = own.groupBy("chat").agg(F.array_join(lines, "\n").alias("history"))
    return joined.withColumn("history", F.substring("history", F.greatest(F.length("history") - chars + 1, F.lit(1)), F.lit(chars)))


@F.pandas_udf(T.StructType([T.StructField("queries", T.ArrayType(T.StringType())), T.StructField("keywords", T.ArrayType(T.StringType()))]))
def reply_queries(replies: pd.Series) -> pd.DataFrame:
    """queries and keywords of a reply that may wrap its JSON in prose or fences; blanks and what is no text are dropped."""
    clean = lambda x: [s.strip() for s in x if isinstance(s, str) and s.strip()] if isinstance(x, list) else []
    found = [parse_reply(r) for r in replies]
    return pd.DataFrame({k: [clean(f.get(k)) for f in found] for k in ("queries", "keywords")})


def with_literal(variants: Column, message: Column, most: int = VARIANTS) -> Column:
    """The first `most` variants, and the message itself if it is not among them."""
    own = F.slice(F.coalesce(variants, F.array().cast("array<string>")), 1, max(1, most))
    return F.when(F.coalesce(message, F.lit("")) == "", own).when(F.array_contains(own, message), own).otherwise(F.concat(own, F.array(message)))


def rewritten(questions: DataFrame, model, most: int = VARIANTS) -> DataFrame:
    """(query, variants, keywords) of questions (query, q, history): what model(list of prompts) -> replies makes of them. A
    question whose call or reply fails has itself as its only variant; a blank one is not asked."""
    before = F.when(F.coalesce("history", F.lit("")) != "", F.concat(F.lit("Conversation so far:\n"), "history", F.lit("\n\n"))).otherwise("")
    prompt = F.concat(F.lit(REWRITE + "\n\n"), before, F.lit("User message:\n"), "q", F.lit("\n\nJSON:"))
    blank = strip(F.coalesce("q", F.lit(""))) == ""
    said = complete(questions.where(~blank).select("query", "q", prompt.alias("prompt")), model).withColumn("r", reply_queries("reply"))
    asked = said.select("query", with_literal(F.col("r.queries"), F.col("q"), most).alias("variants"), F.col("r.keywords").alias("keywords"))
    none = questions.where(blank).select("query", F.filter(F.array("q"), lambda x: F.coalesce(x, F.lit("")) != "").alias("variants"), F.array().cast("array<string>").alias("keywords"))
    return asked.unionByName(none)


def retrieve_for(questions: DataFrame, chunks: DataFrame, states: DataFrame, top_k: int = 6, key: str = "id") -> DataFrame:
    """(query, rank, score, and the columns of chunks): keyword search of each question (query, q, library_ids) over those of
    its libraries that are compiled (states: source_id, state), each library with its own statistics, fused by rank within
    the question's budget. A question without any such library finds nothing: its caller sends the full context."""
    chosen = questions.select("query", F.explode("library_ids").alias("source_id")).distinct()
    open_ = chosen.join(states.where("state = 'compiled'").select("source_id"), "source_id", "left_semi")
    lists = bm25(chunks, questions.select("query", "q"), top_k, key, corpus=["source_id"]).join(open_, ["query", "source_id"], "left_semi")
    found = saved(fuse_lists(lists, top_k, key).select("query", key, "score", "rank"), shared_dir(chunks.sparkSession), "found")
    # a few rows for each question go to the chunks, which stay where they are
    return (F.broadcast(found) if found.count() <= HELD else found).join(chunks, key)


def degraded(questions: DataFrame, found: DataFrame) -> DataFrame:
    """Questions that found nothing and get the full context instead."""
    return questions.join(found.select("query").distinct(), "query", "left_anti")
