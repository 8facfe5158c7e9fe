"""Rendering of prompts and exports, message assembly, trees of prompts, references between envelopes."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessel.functions.text import estimate_tokens, xml_escape

MESSAGES = "array<struct<role:string,content:string>>"


def library_context(items: DataFrame) -> DataFrame:
    """(library, pos, block): the escaped block of each item (library, pos, label, content) that is not empty. A library may
    hold any number of them: they stay rows, and whoever reads them in order of pos has the context."""
    block = F.concat(F.lit('<item label="'), xml_escape("label"), F.lit('">\n'), xml_escape("content"), F.lit("\n</item>"))
    return items.where(F.coalesce("content", F.lit("")) != "").select("library", "pos", block.alias("block"))


def within_context(blocks: DataFrame, tokens: int) -> DataFrame:
    """(library, context): the first blocks of each library that fit into a budget of estimated tokens, as one text."""
    total = F.sum(estimate_tokens("block")).over(Window.partitionBy("library").orderBy("pos"))
    own = blocks.withColumn("__t", total).where(F.col("__t") <= tokens)
    return own.groupBy("library").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "block"))), lambda x: x["block"]), "\n").alias("context"))


def before_last_user(messages: Column, extra: Column) -> Column:
    """The messages with `extra` in front of the last user turn, or at the end if there is none."""
    roles = F.reverse(F.transform(messages, lambda m: m["role"]))
    at = F.array_position(roles, "user").cast("int")
    cut = F.when(at > 0, F.size(messages) - at).otherwise(F.size(messages))
    return F.concat(F.slice(messages, F.lit(1), cut), F.array(extra), F.slice(messages, cut + 1, F.size(messages)))


def conversation(messages: DataFrame) -> DataFrame:
    """(chat, messages): ordered arrays of (role, content)."""
    own = F.array_sort(F.collect_list(F.struct("idx", F.struct("role", "content").alias("m"))))
    return messages.groupBy("chat").agg(F.transform(own, lambda x: x["m"]).alias("messages"))


def merge_trees(old: DataFrame, new: DataFrame) -> DataFrame:
    """Prompts (kind, group, category, prompt, text, pos): new ones join their place by name; the same name with the same
    text is there already, with another text it gets (2), (3), ... after it."""
    place = ["kind", "group", "category"]
    fresh = new.join(old.select(*place, "prompt", "text"), [*place, "prompt", "text"], "left_anti")
    taken = old.groupBy(*place, "prompt").agg(F.count("*").alias("__n"))
    k = F.row_number().over(Window.partitionBy(*place, "prompt").orderBy("pos")) + F.coalesce("__n", F.lit(0))
    named = fresh.join(taken, [*place, "prompt"], "left").withColumn("__k", k)
    named = named.withColumn("prompt", F.when(F.col("__k") == 1, F.col("prompt")).otherwise(F.concat("prompt", F.lit(" ("), F.col("__k").cast("string"), F.lit(")"))))
    return old.unionByName(named.select(*old.columns))


def within_budget(images: DataFrame, budget: int) -> DataFrame:
    """Images (chat, id, size) in order of id until the budget of a chat is spent: the first that overflows ends it."""
    total = F.sum("size").over(Window.partitionBy("chat").orderBy("id"))
    return images.withColumn("__t", total).where(F.col("__t") <= budget).drop("__t")


def remapped(ids: Column, mapping: Column) -> Column:
    """Ids through a map; those that are not in it stay."""
    return F.transform(ids, lambda i: F.coalesce(F.try_element_at(mapping, i), i))


def has_keys(reply: Column, required: list[str]) -> Column:
    """Whether a reply is a JSON object with all keys."""
    keys = F.json_object_keys(reply)
    return F.coalesce(F.size(F.array_except(F.array(*[F.lit(k) for k in required]).cast("array<string>"), keys)) == 0, F.lit(False))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def locate(docs: pd.Series, parts: pd.Series) -> pd.Series:
    """[start, end) of a passage: as it is, else with any white space, else by its first forty characters; null if nowhere."""
    import re

    def find(doc: str | None, part: str | None):
        if not doc or not part or not part.strip():
            return None
        if (at := doc.find(part)) >= 0:
            return [at, at + len(part)]
        words = r"\s+".join(map(re.escape, part.split()))
        if m := re.search(words, doc):
            return list(m.span())
        head = part.strip()[:40]
        if len(head) >= 12 and (at := doc.find(head)) >= 0:
            return [at, at + len(head)]
        return None

    return pd.Series([find(d, p) for d, p in zip(docs, parts)])


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("author", T.StringType()), T.StructField("text", T.StringType())])))
def comments(payloads: pd.Series) -> pd.Series:
    """Objects with an author and a text anywhere in a JSON payload, in order; the same author and first 85 characters once."""

    def walk(x, out: dict) -> dict:
        if isinstance(x, dict):
            if isinstance(x.get("author"), str) and isinstance(x.get("text"), str) and x["text"].strip():
                out.setdefault((x["author"], x["text"][:85]), {"author": x["author"], "text": x["text"].strip()})
            for v in x.values():
                walk(v, out)
        elif isinstance(x, list):
            for v in x:
                walk(v, out)
        return out

    def one(raw):
        try:
            return list(walk(json.loads(raw), {}).values())
        except (TypeError, ValueError, RecursionError):
            return []

    return payloads.map(one)


def addresses(first: Column, last: Column, most: int = 1024) -> Column:
    """Dotted addresses of a range of numbers; null if it runs backwards or has more than `most`."""
    dotted = lambda n: F.concat_ws(".", *[F.pmod(F.floor(n / 2**s), F.lit(256)).cast("int").cast("string") for s in (24, 16, 8, 0)])
    return F.when((last >= first) & (last - first < most), F.transform(F.sequence(first, last), dotted))
