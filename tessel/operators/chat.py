"""Conversation shaping over a table of messages (chat, idx, role, content, intermediate): corpora, windows, usage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessel.functions.text import clean_transcript, data_blocks, estimate_tokens, strip, without_data, words

MIN_CHARS, KEEP_CALLS, AUTO_WORDS = 40, 200, 400


def _shown() -> F.Column:
    return F.col("role").isin("user", "assistant") & _kept()


def _kept() -> F.Column:
    return ~F.coalesce(F.col("intermediate"), F.lit(False))


def _last_user(messages: DataFrame) -> DataFrame:
    """Adds the place of the last user turn that is not an intermediate one."""
    return messages.withColumn("last_user", F.max(F.when((F.col("role") == "user") & _kept(), F.col("idx"))).over(Window.partitionBy("chat")))


def thread_items(messages: DataFrame, least: int = MIN_CHARS) -> DataFrame:
    """(chat, idx, role, content): what of a chat can be searched: shown turns but for the last user turn (the question
    itself), of `least` characters or more. User turns lose their data blocks, which are items of their own; answers are
    taken as they are."""
    own = _last_user(messages).where(_shown() & (F.col("last_user").isNull() | (F.col("idx") != F.col("last_user"))))
    content = F.when(F.col("role") == "user", without_data("content")).otherwise(strip(F.coalesce("content", F.lit(""))))
    return own.select("chat", "idx", "role", content.alias("content")).where(F.length("content") >= least)


def data_items(messages: DataFrame, isolated: bool = False) -> DataFrame:
    """(chat, item_id, content): the data blocks of each user turn (of the last one only if the chat is isolated), as one item
    that is named by the turn's place among those that are not intermediate."""
    own = _last_user(messages.where(_kept())).withColumn("k", F.row_number().over(Window.partitionBy("chat").orderBy("idx")) - 1).where(F.col("role") == "user")
    own = own.where(F.col("idx") == F.col("last_user")) if isolated else own
    blocks = own.select("chat", F.concat(F.lit("data:"), "k").alias("item_id"), strip(F.array_join(data_blocks("content"), "\n\n")).alias("content"))
    return blocks.where(F.col("content") != "")


def visible(messages: DataFrame, window: int, isolated: bool = False) -> DataFrame:
    """History up to the last user turn: that turn alone if isolated, else the last max(1, window) shown messages."""
    own = _last_user(messages).where(_shown() & (F.col("idx") <= F.col("last_user")))
    if isolated:
        return own.where(F.col("idx") == F.col("last_user")).drop("last_user")
    k = F.row_number().over(Window.partitionBy("chat").orderBy(F.desc("idx")))
    return own.withColumn("__k", k).where(F.col("__k") <= max(1, window)).drop("__k", "last_user")


def usage(messages: DataFrame) -> DataFrame:
    """Token estimates by part of the prompt: system, retrieved passages and user text; answers do not count."""
    n = estimate_tokens("content")
    retrieved = F.col("content").contains("<retrieved>")
    part = lambda cond: F.coalesce(F.sum(F.when(cond, n)), F.lit(0)).cast("long")
    system, user = F.col("role") == "system", F.col("role") == "user"
    out = messages.groupBy("chat").agg(part(system & ~retrieved).alias("system"), part((system | user) & retrieved).alias("rag"), part(user & ~retrieved).alias("user"))
    return out.withColumn("total", F.col("system") + F.col("rag") + F.col("user"))


def capped(calls: DataFrame, keep: int = KEEP_CALLS) -> DataFrame:
    """The newest `keep` entries of each chat; private chats and those without an id leave none."""
    own = calls.where(F.col("chat").isNotNull())
    own = own.where(~F.coalesce(F.col("private"), F.lit(False))) if "private" in calls.columns else own
    k = F.row_number().over(Window.partitionBy("chat").orderBy(F.desc("ts"), F.desc("call")))
    return own.withColumn("__k", k).where(F.col("__k") <= keep).drop("__k")


def search_active(text: str, enabled, libraries, threshold: int = AUTO_WORDS) -> F.Column:
    """Whether a chat searches: asked for, or a library is chosen, or it decides itself and has enough words."""
    mode = F.coalesce(F.col(enabled), F.lit("off"))
    return (mode == "on") | (F.size(F.coalesce(F.col(libraries), F.array().cast("array<string>"))) > 0) | ((mode == "auto") & (F.size(words(text)) >= threshold))


def speaker_paragraphs(cues: DataFrame, by: str = "doc") -> DataFrame:
    """(doc, para, speaker, text): neighbouring cues of one speaker joined (gaps and islands)."""
    w = Window.partitionBy(by).orderBy("pos")
    new = (~F.col("speaker").eqNullSafe(F.lag("speaker").over(w))) | (F.row_number().over(w) == 1)
    own = cues.withColumn("para", F.sum(new.cast("int")).over(w) - 1)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ")
    return own.groupBy(by, "para").agg(F.first("speaker").alias("speaker"), text.alias("text"))


def repair_references(chats: DataFrame, libraries: DataFrame, ids: str = "library_ids") -> DataFrame:
    """Chats without the ids of libraries that are gone; order kept."""
    each = chats.select("chat", F.posexplode_outer(ids).alias("pos", "id"))
    known = each.join(libraries.select(F.col("id"), F.lit(True).alias("known")), "id", "left")
    return known.groupBy("chat").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("known"), F.struct("pos", "id")))), lambda x: x["id"]).alias(ids))
