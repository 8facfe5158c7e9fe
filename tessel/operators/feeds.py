"""Feeds, pages and caches: filters, tallies, domain rules, captions, merge rules of cached entries."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessel.functions.text import fold, html_to_text

MAX_NOTES, MIN_PAGE, PAGE_HEAD = 20_000, 400, 6_000
#: What a page that was not let through says.
BLOCK_MARKERS = (
    "log in to view", "login to view", "log in to continue", "sign in to continue", "please log in", "please sign in", "sign in to read", "log in to read", "you must be logged in", "subscribe to read",
    "subscribe to continue", "create an account to continue", "create a free account", "register to continue", "enable javascript", "please enable javascript", "javascript is required", "access denied",
    "are you a robot", "verify you are human", "unusual traffic", "this content is available to subscribers", "become a member to", "captcha", "cf-browser-verification", "just a moment...",
)
#: Rank of where a transcript comes from.
SOURCE_RANK = {"published": 2, "asr": 1}


def parse_terms(raw: str | Sequence[str] | None) -> list[str]:
    """Terms of a list or a comma list: trimmed, repeats without case dropped, the first spelling kept."""
    parts = raw.split(",") if isinstance(raw, str) else list(raw or [])
    first: dict[str, str] = {}
    for p in map(str.strip, parts):
        if p:
            first.setdefault(p.lower(), p)
    return list(first.values())


def haystack(title: Column, categories: Column, author: Column, notes: Column) -> Column:
    return fold(F.concat_ws(" ", title, F.array_join(categories, " "), author, F.substring(html_to_text(notes), 1, MAX_NOTES)))


def passes(categories: str = "", keywords: str = "", match: str = "any", exclude: str = "") -> Column:
    """Whether an item (categories: array, haystack) passes: whole categories, substrings of the haystack, any or all within a
    field, and across fields; an excluded term vetoes. Without any term everything passes."""
    folded = F.transform("categories", fold)
    has_cat = lambda t: F.array_contains(folded, fold(F.lit(t)))
    has_word = lambda t: F.col("haystack").contains(fold(F.lit(t)))
    keep = F.lit(True)
    for terms, test in ((parse_terms(categories), has_cat), (parse_terms(keywords), has_word)):
        if terms:
            own = F.lit(match == "all")
            for t in terms:
                own = (own & test(t)) if match == "all" else (own | test(t))
            keep = keep & own
    for t in parse_terms(exclude):
        keep = keep & ~(has_cat(t) | has_word(t))
    return keep


def feed_filter(items: DataFrame, categories: str = "", keywords: str = "", match: str = "any", exclude: str = "") -> DataFrame:
    """Items that pass."""
    return items.where(passes(categories, keywords, match, exclude))


#: Terms that a report offers.
OFFERED = 12


def filter_summary(categories: str = "", keywords: str = "", match: str = "any", exclude: str = "") -> str:
    """The filter as one clause."""
    named = {"categories": parse_terms(categories), "keywords": parse_terms(keywords), "without": parse_terms(exclude)}
    bits = [f"{name} {', '.join(terms)}" for name, terms in named.items() if terms]
    return "; ".join(bits + ["all of them"] * (match == "all" and bool(bits))) or "no terms"


def filter_report(items: DataFrame, categories: str = "", keywords: str = "", match: str = "any", exclude: str = "") -> DataFrame:
    """(feed, total, matched, categorised, terms, reason) of each feed of items (feed, pos, categories, haystack): how many items there
    are, pass, and have any category; the most frequent categories without regard to case, ties by first place, each in its first spelling;
    and, where nothing passed, why. Counts are made before the window, which numbers the distinct categories of a feed."""
    ok = F.coalesce(passes(categories, keywords, match, exclude), F.lit(False))
    some = F.filter(F.coalesce("categories", F.array().cast("array<string>")), lambda c: F.trim(c) != "")
    counts = items.groupBy("feed").agg(F.count("*").alias("total"), F.count_if(ok).alias("matched"), F.count_if(F.size(some) > 0).alias("categorised"))
    own = items.select("feed", "pos", F.explode(some).alias("c")).groupBy("feed", fold("c").alias("key")).agg(F.count("*").alias("n"), F.min(F.struct("pos", "c")).alias("first"))
    place = F.row_number().over(Window.partitionBy("feed").orderBy(F.desc("n"), "first"))
    best = own.withColumn("k", place).where(F.col("k") <= OFFERED).groupBy("feed").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "first.c"))), lambda x: x["c"]).alias("terms"))
    said = F.lit(f"None of the items pass ({filter_summary(categories, keywords, match, exclude)})")
    reason = F.when(F.col("matched") > 0, F.lit(None).cast("string")).when(F.col("categorised") == 0, F.concat(said, F.lit("; they have no categories, so only keywords can tell them apart.")))
    if parse_terms(categories):
        reason = reason.when(F.size("terms") > 0, F.concat(said, F.lit("; a category counts as a whole, and there are: "), F.array_join("terms", ", "), F.lit(".")))
    reason = reason.otherwise(F.concat(said, F.lit("; fewer terms, or any of them, would let more through.")))
    return counts.join(best, "feed", "left").select("feed", "total", "matched", "categorised", F.coalesce("terms", F.array().cast("array<string>")).alias("terms"), reason.alias("reason"))


def first_items(items: DataFrame, limit: int, by: Sequence[str] = ("feed",)) -> DataFrame:
    """The first items of each feed, in feed order, after any filter."""
    k = F.row_number().over(Window.partitionBy(*by).orderBy("pos"))
    return items.withColumn("__k", k).where(F.col("__k") <= limit).drop("__k")


def category_tally(items: DataFrame, top: int = 12) -> DataFrame:
    """(category, n, first_pos): items of each folded category under its first spelling, most frequent first."""
    own = items.select("pos", F.explode("categories").alias("name")).withColumn("key", fold("name")).where(F.col("key") != "")
    tally = own.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("pos", "name")).alias("f"))
    return tally.select(F.col("f.name").alias("category"), "n", F.col("f.pos").alias("first_pos")).orderBy(F.desc("n"), "first_pos").limit(top)


def host(url) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(F.try_parse_url(F.col(url) if isinstance(url, str) else url, F.lit("HOST")), F.lit(""))), r"^www\.", "")


def on_domains(url, domains: Sequence[str]) -> Column:
    """The host is one of the domains or below one."""
    own = host(url)
    names = [d.strip().lower().removeprefix("https://").removeprefix("http://").split("/")[0].removeprefix("www.") for d in domains if d.strip()]
    out = F.lit(not names)
    for d in names:
        out = out | (own == d) | own.endswith("." + d)
    return out


def blocked(text) -> Column:
    """A page that is too short or says that it was not let through."""
    t = F.col(text) if isinstance(text, str) else text
    head = F.lower(F.substring(t, 1, PAGE_HEAD))
    return t.isNull() | (F.length(t) < MIN_PAGE) | head.rlike("|".join(re.escape(m) for m in BLOCK_MARKERS))


def first_by(df: DataFrame, key: Sequence[str], pos: str = "pos") -> DataFrame:
    """The first row of each key (first spelling, first address)."""
    k = F.row_number().over(Window.partitionBy(*key).orderBy(pos))
    return df.withColumn("__k", k).where(F.col("__k") == 1).drop("__k")


def caption_pick(tracks: DataFrame) -> DataFrame:
    """One track of each video: manual English, else English, else one that is named English, else the first."""
    lang, manual = F.lower(F.coalesce("lang", F.lit(""))), F.coalesce("manual", F.lit(False))
    english = lang.startswith("en")
    rank = F.when(english & manual, 0).when(english, 1).when(F.lower(F.coalesce("name", F.lit(""))).contains("english"), 2).otherwise(3)
    return tracks.groupBy("video").agg(F.min_by(F.struct("pos", "lang", "manual"), F.struct(rank, "pos")).alias("t")).select("video", "t.pos", "t.lang", "t.manual")


def merge_cache(old: DataFrame, new: DataFrame, refresh: bool = False) -> DataFrame:
    """(id, transcript, source, url) after a write: the better source wins; of equal ones a refresh, a changed published
    address or a longer text does; blanks never clear what is there."""
    rank = lambda c: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SOURCE_RANK.items() for x in kv]), F.coalesce(c, F.lit(""))), F.lit(0))
    cols = ("transcript", "source", "url")
    both = old.select("id", *[F.col(c).alias(f"o_{c}") for c in cols]).join(new.select("id", *[F.col(c).alias(f"n_{c}") for c in cols]), "id", "full_outer")
    has_new, has_old = F.coalesce(F.col("n_transcript"), F.lit("")) != "", F.coalesce(F.col("o_transcript"), F.lit("")) != ""
    a, b = rank(F.col("o_source")), rank(F.col("n_source"))
    equal_wins = F.lit(refresh) | ((F.col("n_source") == "published") & ~F.col("n_url").eqNullSafe(F.col("o_url"))) | (F.length("n_transcript") > F.length("o_transcript"))
    wins = has_new & (~has_old | (b > a) | ((a == b) & equal_wins))
    return both.select("id", *[F.when(wins, F.col(f"n_{c}")).otherwise(F.col(f"o_{c}")).alias(c) for c in cols])


def churn(old: DataFrame, new: DataFrame) -> DataFrame:
    """(kept, known, churned): whether most of at least four known ids are gone."""
    known = old.select("id").distinct().join(new.select("id", F.lit(1).alias("here")).distinct(), "id", "left")
    own = known.agg(F.count("here").alias("kept"), F.count("*").alias("known"))
    return own.withColumn("churned", (F.col("known") >= 4) & (F.col("kept") < F.col("known") * 0.5))


def union_by_name(old: DataFrame, new: DataFrame, key: str = "name") -> DataFrame:
    """old, and what of new has another name: what exists wins."""
    return old.unionByName(new.join(old.select(key), key, "left_anti").select(*old.columns))


def unique_names(df: DataFrame, name: str, pos: str, start: int = 1) -> DataFrame:
    """Repeated names get (k) in order of pos."""
    k = F.row_number().over(Window.partitionBy(name).orderBy(pos)) - 1
    return df.withColumn("unique_name", F.when(k == 0, F.col(name)).otherwise(F.concat(F.col(name), F.lit(" ("), (k - 1 + start).cast("string"), F.lit(")"))))


def lanes(df: DataFrame, n: int, pos: str) -> DataFrame:
    """Lane of each item by its dense place."""
    return df.withColumn("lane", F.pmod(F.col(pos), F.lit(n)).cast("int"))


def common_models(models: DataFrame) -> DataFrame:
    """Models that every server has."""
    n = models.agg(F.countDistinct("server").alias("servers"))
    own = models.groupBy("model").agg(F.countDistinct("server").alias("has"))
    return own.join(F.broadcast(n)).where(F.col("has") == F.col("servers")).select("model")  # n is one row


def unreferenced(images: DataFrame, live: DataFrame, now: float, age: float = 3600.0) -> DataFrame:
    """Images that nothing refers to and that are old enough to go."""
    return images.where(F.col("ts") <= now - age).join(live.select("id").distinct(), "id", "left_anti")


def covered(advertised: Column, transcript: Column, source: Column, known_url: Column, missing: Column, wants_asr: Column) -> Column:
    """Whether a cached entry answers an ask: a new published address that is not the cached one does not; any transcript
    does; what is known to be missing answers only asks without speech recognition."""
    fresh = (F.coalesce(advertised, F.lit("")) != "") & ~advertised.eqNullSafe(known_url) & ~source.eqNullSafe(F.lit("published"))
    return F.when(fresh, False).when(F.coalesce(transcript, F.lit("")) != "", True).otherwise(F.coalesce(missing, F.lit(False)) & ~wants_asr)


def merge_video(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, title, transcript, comments) after a write: both halves on their own, never shorter than before; a placeholder
    title does not replace a real one."""
    both = old.select("id", *[F.col(c).alias(f"o_{c}") for c in ("title", "transcript", "comments")]).join(new.select("id", *[F.col(c).alias(f"n_{c}") for c in ("title", "transcript", "comments")]), "id", "full_outer")
    real = (F.coalesce("n_title", F.lit("")) != "") & (F.col("n_title") != F.col("id"))
    size = lambda c: F.coalesce(F.size(c), F.lit(-1))
    return both.select(
        "id", F.when(real, F.col("n_title")).otherwise(F.coalesce("o_title", "n_title")).alias("title"),
        F.when(F.coalesce("n_transcript", F.lit("")) != "", F.col("n_transcript")).otherwise(F.col("o_transcript")).alias("transcript"),
        F.when(size("n_comments") >= size("o_comments"), F.col("n_comments")).otherwise(F.col("o_comments")).alias("comments"),
    )


def cache_stats(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count("*").alias("entries"), F.coalesce(F.sum(F.octet_length("transcript")), F.lit(0)).alias("bytes"), F.count_if(F.col("source") == "asr").alias("transcribed"))


def changed_listings(old: DataFrame, new: DataFrame) -> DataFrame:
    """Listings (feed, body) whose content is not the cached one (feed, hash)."""
    return new.withColumn("hash", F.sha2("body", 256)).join(old.select("feed", "hash"), ["feed", "hash"], "left_anti")
