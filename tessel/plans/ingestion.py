"""Queries over pages, feeds and captions: extraction, filters, tallies, cleaners."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessel.functions import captions, pages
from tessel.functions import text as T
from tessel.operators import feeds
from tessel.plans.registry import query, table

_FOLD = "trim(regexp_replace(replace(replace(lower({0}), 'ß', 'ss'), '&', ' and '), '[^0-9a-z]+', ' ', 'g'))"


def items(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    own = d.select(F.col("doc_id").alias("pos"), F.col("source").alias("feed"), F.array("lang", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Src & "), "source")).otherwise(F.concat(F.lit("SRC and "), "source"))).alias("categories"), "text")
    return own.withColumn("haystack", feeds.haystack(F.lit("title"), F.col("categories"), F.lit("me"), F.col("text")))


_ITEMS = f"""items AS (SELECT doc_id AS pos, lang, source, {_FOLD.format("'title ' || lang || ' ' || 'src and ' || source || ' me ' || substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 20000)")} AS haystack FROM documents)"""


@query(f"WITH {_ITEMS} SELECT pos FROM items WHERE (lang = 'fr' OR lang = 'de') AND (contains(haystack, 'idiot') OR contains(haystack, 'que'))")
def feed_filter_any(spark, sf_dir):
    return feeds.feed_filter(items(spark, sf_dir), "FR, de, fr", "idiot,Que").select("pos")


@query(f"WITH {_ITEMS} SELECT pos FROM items WHERE lang = 'en' AND source = 'src3' AND contains(haystack, 'the') AND contains(haystack, 'and')")
def feed_filter_all(spark, sf_dir):
    return feeds.feed_filter(items(spark, sf_dir), "en, src & src3", "the, and", "all").select("pos")


@query(f"WITH {_ITEMS} SELECT pos FROM items WHERE NOT (lang = 'en' OR contains(haystack, 'en') OR contains(haystack, 'der'))")
def feed_filter_exclude(spark, sf_dir):
    return feeds.feed_filter(items(spark, sf_dir), exclude="en, der").select("pos")


@query("SELECT doc_id AS pos FROM documents WHERE lang = 'es' QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 7")
def feed_first_items(spark, sf_dir):
    return feeds.first_items(feeds.feed_filter(items(spark, sf_dir), "es"), 7).select("pos")


@query("""WITH e AS (SELECT doc_id AS pos, lang AS key, lang AS name FROM documents UNION ALL SELECT doc_id, 'src and ' || source, CASE WHEN doc_id % 3 = 0 THEN 'Src & ' ELSE 'SRC and ' END || source FROM documents)
SELECT arg_min(name, pos) AS category, count(*) AS n, min(pos) AS first_pos FROM e GROUP BY key ORDER BY n DESC, first_pos LIMIT 12""")
def category_tally(spark, sf_dir):
    return feeds.category_tally(items(spark, sf_dir))


_HOST = r"regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)), '^www\.', '')"


@query(f"SELECT {_HOST} AS host, count(*) AS n FROM pages GROUP BY 1")
def pages_by_host(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(feeds.host("url").alias("host")).agg(F.count("*").alias("n"))


@query(f"SELECT page_id FROM pages WHERE {_HOST} LIKE '%.com' OR {_HOST} = 'com' OR {_HOST} LIKE '%.org'")
def domain_filter(spark, sf_dir):
    return table(spark, sf_dir, "pages").where(feeds.on_domains("url", ["https://com/x", "ORG"])).select("page_id")


@query("SELECT page_id, length(html) < 400 OR " + " OR ".join(f"contains(lower(substr(html, 1, 6000)), '{m}')" for m in feeds.BLOCK_MARKERS) + " AS blocked FROM pages")
def blocked_page(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", feeds.blocked("html").alias("blocked"))


@query()
def page_titles(spark, sf_dir):
    """Entities of any kind are decoded, which SQL cannot: held against plain Python in the tests."""
    return table(spark, sf_dir, "pages").select("page_id", T.page_title("html").alias("title"))


@query()
def page_text(spark, sf_dir):
    """Held against plain Python in the tests."""
    return table(spark, sf_dir, "pages").select("page_id", pages.page_text("html").alias("text"))


@query(r"""SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(regexp_replace(regexp_replace(x, '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g'), '\s+([,.;:!?%])', '\1', 'g')), lambda x: length(x) >= 3 AND NOT regexp_matches(x, '^https?://\S+$')), chr(10) || chr(10)) AS text FROM documents""")
def norm_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.norm_lines("text").alias("text"))


@query(r"""SELECT doc_id, len(list_filter(list_transform(string_split(text, '. '), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''))::int AS n, array_to_string(list_filter(list_transform(string_split(text, '. '), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')[1:3], '|') AS first FROM documents""")
def split_text(spark, sf_dir):
    parts = T.split_text("text", ". ")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(parts).alias("n"), F.array_join(F.slice(parts, 1, 3), "|").alias("first"))


_SPACED = r"regexp_replace({0}, '([.,!?;:])(\S)', '\1 \2', 'g')"


@query(r"SELECT conv_id, turn, trim(regexp_replace(" + _SPACED.format(_SPACED.format(r"regexp_replace('♪ [noise] ' || text || '...end,of it (Music)', '(?i)[♪♫]+|\[.*?\]|\(music\)|\(sound effect\)', ' ', 'g')")) + r", '\s+', ' ', 'g')) AS text FROM conversations")
def clean_transcript(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.clean_transcript(F.concat(F.lit("♪ [noise] "), "text", F.lit("...end,of it (Music)"))).alias("text"))


@query(r"""WITH t AS (SELECT conv_id, turn, role, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM conversations)
SELECT conv_id, turn, array_to_string(list_filter([role || ': x', trim(regexp_replace(t, '</?[a-zA-Z][^>]*>', '', 'g'))], lambda x: x <> ''), '|') AS cues FROM t""")
def caption_cues(spark, sf_dir):
    """Each turn as a caption of two cues, the second of which is its whole text."""
    srt = F.concat(F.lit("1\n00:00:01,000 --> 00:00:02,000\n<i>"), "role", F.lit("</i>: x\n\n2\n00:00:03,000 --> 00:00:04,000\n"), F.trim(F.regexp_replace("text", r"\s+", " ")), F.lit("\n"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(F.transform(captions.cues(srt), lambda c: c["text"]), "|").alias("cues"))


@query("SELECT user_id AS author, props AS text, min(event_id) AS pos FROM events GROUP BY ALL")
def first_spelling(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("author"), F.col("props").alias("text"), F.col("event_id").alias("pos"))
    return feeds.first_by(e, ["author", "text"])


@query("SELECT page_id, CASE WHEN page_id % 3 < 2 THEN substr(md5(url), 1, 11) END AS video FROM pages")
def video_ids(spark, sf_dir):
    """Watch and short addresses whose id is a hash of the page's url, and the url itself, which has none."""
    key = F.substring(F.md5("url"), 1, 11)
    k = F.col("page_id") % 3
    url = F.when(k == 0, F.concat(F.lit("https://www.youtube.com/watch?t=1&v="), key)).when(k == 1, F.concat(F.lit("youtu.be/"), key, F.lit("?t=9"))).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", T.video_id(url).alias("video"))


@query("SELECT doc_id, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS xml, CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || chr(10) || '[truncated]' ELSE text END AS clipped FROM documents")
def xml_and_clip(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.xml_escape("text").alias("xml"), T.clipped("text", 500).alias("clipped"))


@query("SELECT event_id, strftime(ts, '%H:%M:%S') AS clock FROM events")
def clock_times(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.clock(F.unix_seconds(F.col("ts").cast("timestamp")) % 86400).alias("clock"))


@query("SELECT p_partkey, CASE WHEN p_size = 0 THEN 1100 ELSE least(1600, greatest(1, ceil(p_size * 30 * p_size * 20 / 750.0))) END::bigint AS tokens FROM part")
def image_tokens(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.image_tokens(F.col("p_size") * 30, F.col("p_size") * 20).alias("tokens"))
