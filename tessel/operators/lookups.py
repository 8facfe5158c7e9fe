"""Lookups with fallbacks: labels, keys of feed items, ranked links, context windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessel.functions.text import strip

#: Kinds of transcripts, best first.
TRANSCRIPT_TYPES = ("application/json", "text/vtt", "application/srt", "text/srt", "application/x-subrip", "text/plain", "text/html")
#: What a reasoning model's name holds.
REASONING_HINTS = (
    "deepseek-r1", "-r1:", "/r1", "qwq", "reasoning", "-thinking", "thinker", "magistral", "phi4-reasoning", "phi-4-reasoning", "exaone-deep", "cogito", "marco-o1", "openthinker", "deepscaler",
)


def present(c: Column) -> Column:
    """The trimmed text, or null if it is blank."""
    t = F.trim(c)
    return F.when(t != "", t)


def with_labels(rows: DataFrame, live: DataFrame) -> DataFrame:
    """Rows (item_id, source_id, meta) with label: the live one (item_id, label) if there is any, else that of meta, else
    the id. Live labels are joined, not broadcast, as a library may hold any number of items."""
    names = live.select("item_id", present(F.col("label")).alias("__live")).dropDuplicates(["item_id"])
    out = rows.join(names, "item_id", "left")
    return out.withColumn("label", F.coalesce("__live", present(F.get_json_object("meta", "$.label")), present(F.col("item_id")), present(F.col("source_id")), F.lit("excerpt"))).drop("__live")


def normal_url(url: Column) -> Column:
    """Scheme and host in lower case, without the scheme's own port and without a fragment; path and query as they are."""
    u = F.trim(F.coalesce(url, F.lit("")))
    part = lambda k: F.regexp_extract(u, r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://(?:[^@/?#]*@)?([^:/?#]*)(?::(\d+))?)?([^?#]*)(\?[^#]*)?", k)
    scheme, port = F.lower(part(1)), part(3)
    scheme = F.when(scheme == "", "https").otherwise(scheme)
    own = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")) | (port == "")
    return F.concat(scheme, F.lit("://"), F.lower(part(2)), F.when(own, "").otherwise(F.concat(F.lit(":"), port)), part(4), part(5))


def feed_id(url: Column) -> Column:
    return F.substring(F.sha2(normal_url(url), 256), 1, 40)


def episode_key(guid: Column, enclosure: Column, link: Column) -> Column:
    """(key, from): the first of guid, enclosure and link that is not blank."""
    first = lambda c, name: F.when(present(c).isNotNull(), F.struct(present(c).alias("key"), F.lit(name).alias("from")))
    return F.coalesce(first(guid, "guid"), first(enclosure, "enclosure"), first(link, "link"), F.struct(F.lit("").alias("key"), F.lit("").alias("from")))


def episode_id(feed: Column, key: Column) -> Column:
    return F.substring(F.sha2(F.concat(feed, F.lit("\x00"), key), 256), 1, 40)


def by_ladder(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """left with the value of right that has the same first key, else the same second, and so on; blanks match nothing."""
    out = left
    for k, name in enumerate(keys):
        own = right.where(present(F.col(name)).isNotNull()).groupBy(name).agg(F.min_by(value, "pos").alias(f"__v{k}"))
        out = out.join(own, name, "left")
    return out.withColumn(value, F.coalesce(*[f"__v{k}" for k in range(len(keys))])).drop(*[f"__v{k}" for k in range(len(keys))])


def ranked_links(links: DataFrame, language: str = "") -> DataFrame:
    """(item, rank, url): readable links by kind, then captions, then language, then place."""
    kind = F.array_position(F.array(*[F.lit(t) for t in TRANSCRIPT_TYPES]), F.lower(F.trim(F.coalesce("type", F.lit("")))))
    lang = F.lower(F.coalesce("language", F.lit("")))
    near = F.lit(not language) | (lang == "") | lang.startswith(language[:2])
    own = links.where((kind > 0) & present(F.col("url")).isNotNull())
    w = Window.partitionBy("item").orderBy(kind, (~F.coalesce(F.col("rel") == "captions", F.lit(False))).cast("int"), (~near).cast("int"), "pos")
    return own.withColumn("rank", F.row_number().over(w) - 1).select("item", "rank", "url")


def context_window(kind: Column, asked: Column, default: int, windows: dict[str, int], fallback: int) -> Column:
    """What a local model was asked for, else a provider's own window."""
    own = F.coalesce(*[F.when(kind == k, v) for k, v in windows.items()], F.lit(fallback)) if windows else F.lit(fallback)
    return F.when(F.coalesce(kind, F.lit("ollama")) == "ollama", F.coalesce(F.when(asked > 0, asked), F.lit(default))).otherwise(own)


def looks_like_reasoning(name: Column) -> Column:
    n = F.lower(F.coalesce(name, F.lit("")))
    out = F.lit(False)
    for hint in REASONING_HINTS:
        out = out | n.contains(hint)
    return out


def ordered_union(sources: Sequence[DataFrame], columns: Sequence[str]) -> DataFrame:
    """Sources one after the other, with the place of the source beside each item's own."""
    parts = [s.select(*columns, "item_pos").withColumn("source_pos", F.lit(k)) for k, s in enumerate(sources)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def first_media(enclosures: Column, media: Sequence[str] = ("audio/", "video/"), suffixes: str = r"(?i)\.(mp3|m4a|wav|ogg|opus|flac|aac|mp4|mkv|webm|mov)$") -> Column:
    """The first enclosure (href, type) with a media type, or a media suffix before any query."""
    good = lambda e: (F.trim(F.coalesce(e["href"], F.lit(""))) != "") & (
        F.coalesce(e["type"], F.lit("")).rlike("(?i)^(" + "|".join(media) + ")") | F.regexp_replace(e["href"], r"[?#].*$", "").rlike(suffixes)
    )
    return F.try_element_at(F.filter(enclosures, good), F.lit(1))


def selected(libraries: DataFrame, chats: DataFrame) -> DataFrame:
    """(chat, ...): the libraries (id, pos, ...) that each chat (chat, library_ids) names, in the order of the libraries."""
    chosen = chats.select("chat", F.explode("library_ids").alias("id")).distinct()
    return libraries.join(chosen, "id")


def enumerated(items: DataFrame) -> DataFrame:
    """Items (library, pos, id, label, filename, type, content) that say something, with item_id (the library and place if it
    has no id) and label (else the file's name, else by type)."""
    blank = lambda c: F.nullif(F.coalesce(F.col(c), F.lit("")), F.lit(""))
    kind = F.when(F.coalesce("type", F.lit("")) == "", "Item").otherwise(F.initcap("type"))
    own = items.withColumn("content", strip(F.coalesce("content", F.lit("")))).where("content <> ''")
    return own.withColumns({"item_id": F.coalesce(blank("id"), F.concat_ws(":", "library", "pos")), "label": F.coalesce(blank("label"), blank("filename"), kind)})


def with_ids(items: DataFrame, key: list[str], changed: str = "filled") -> DataFrame:
    """Missing ids become twelve digits of a hash of the row's key, so that reruns agree; `changed` says which were filled."""
    missing = F.coalesce("id", F.lit("")) == ""
    return items.withColumn(changed, missing).withColumn("id", F.when(missing, F.substring(F.sha2(F.to_json(F.struct(*key)), 256), 1, 12)).otherwise(F.col("id")))


def masked(profiles: DataFrame, secrets: list[str]) -> DataFrame:
    """Without the columns that hold secrets; has_<name> says whether there was one."""
    flags = {f"has_{c}": F.coalesce(F.col(c).cast("string"), F.lit("")) != "" for c in secrets if c in profiles.columns}
    return profiles.withColumns(flags).drop(*[c for c in secrets if c in profiles.columns])


def single_turn(prompt: Column) -> Column:
    """A prompt as the messages of a chat of one turn."""
    return F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content")))


def search_scope(scope: Column) -> Column:
    """What a chat searches beside its libraries; anything unknown counts as its attachments."""
    own = F.lower(strip(F.coalesce(scope, F.lit(""))))
    return F.when(own.isin("attachments", "thread", "both"), own).otherwise("attachments")


def eligible(chats: DataFrame, built: DataFrame, manual: bool = False, reread: bool = False) -> DataFrame:
    """Chats (chat, created, private) that memories may be taken from, oldest first: private ones only if a person asks,
    and those that were read before (built: chat) only if they are to be read again."""
    out = chats if manual else chats.where(~F.coalesce("private", F.lit(False)))
    out = out if reread else out.join(built.select("chat"), "chat", "left_anti")
    return out.orderBy(F.coalesce("created", F.lit("")), "chat")


def cached(entries: DataFrame, version: int) -> DataFrame:
    """Cache entries that can be used: of this version and readable; others count as missing."""
    return entries.where((F.col("v") == version) & F.col("body").isNotNull())


def by_id(found: DataFrame, chunks: DataFrame, key: str = "id") -> DataFrame:
    """Rows of the chunks for the hits (key, score, rank) of an index; hits whose row is gone are dropped."""
    return found.join(chunks, key)


def edited_memories(entries: DataFrame, cores: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, outcome) after edits by a person (seq, core, id, text): outcome is saved, or core, gone or text where the core
    is unknown, the entry was deleted meanwhile, or a new entry says nothing. What a person adds is theirs: origin is user.
    The last edit of an entry wins; an edit without a text keeps the old one."""
    known = edits.join(cores.select(F.col("core"), F.lit(True).alias("__core")).distinct(), "core", "left")
    there = entries.select("core", "id", F.lit(True).alias("__there"))
    known = known.join(there, ["core", "id"], "left")
    new, blank = F.coalesce("id", F.lit("")) == "", strip(F.coalesce("text", F.lit(""))) == ""
    outcome = F.when(F.col("__core").isNull(), "core").when(~new & F.col("__there").isNull(), "gone").when(new & blank, "text").otherwise("saved")
    judged = known.withColumns({"outcome": outcome, "__new": new, "text": strip("text")}).drop("__core", "__there")
    last = judged.where((F.col("outcome") == "saved") & ~F.col("__new") & ~blank).groupBy("core", "id").agg(F.max_by("text", "seq").alias("__text"))
    changed = entries.join(last, ["core", "id"], "left").withColumn("text", F.coalesce("__text", "text")).select(*entries.columns)
    fresh = judged.where((F.col("outcome") == "saved") & F.col("__new")).select("core", F.concat_ws("-", "core", F.lit("u"), "seq").alias("id"), "text")
    added = fresh.withColumns({"category": F.lit("other"), "importance": F.lit(5), "pinned": F.lit(False), "origin": F.lit("user"), "created": F.col("id")}).select(*[F.col(c).cast(entries.schema[c].dataType) for c in entries.columns])
    return changed.unionByName(added), judged.select("seq", "outcome")
