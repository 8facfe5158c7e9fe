"""Web research over tables of search results and fetched pages: each question's results, pages and context block."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessel.functions.pages import page_text
from tessel.functions.text import html_to_text
from tessel.operators.feeds import blocked, on_domains

#: Results of a search, characters of a page, results that are shown unread.
MAX_CANDIDATES, PAGE_CHARS, EXTRAS = 30, 2200, 5


def results(raw: DataFrame, limit: int = MAX_CANDIDATES, domains: Sequence[str] = ()) -> DataFrame:
    """(query, rank, url, title, description, snippets): the first `limit` results (query, pos, url, title, description,
    snippets: array) of each question: web addresses only, each once, on the given domains only; markup is taken out."""
    web = raw.where(F.col("url").startswith("http"))
    once = web.withColumn("__k", F.row_number().over(Window.partitionBy("query", "url").orderBy("pos"))).where("__k = 1").drop("__k")
    k = F.row_number().over(Window.partitionBy("query").orderBy("pos")) - 1
    first = once.withColumn("rank", k).where(F.col("rank") < limit)
    first = first.where(on_domains("url", list(domains))) if domains else first
    bare = html_to_text(F.coalesce("title", F.lit("")))
    # snippets are cleaned row by row of their own, as entities are decoded outside of array functions
    each = first.select("query", "rank", F.posexplode("snippets").alias("at", "s")).where(F.coalesce("s", F.lit("")) != "").withColumn("s", html_to_text("s"))
    kept = each.groupBy("query", "rank").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "s"))), lambda x: x["s"]).alias("snippets"))
    own = first.select("query", "rank", "url", F.when(bare != "", bare).otherwise(F.col("url")).alias("title"), html_to_text(F.coalesce("description", F.lit(""))).alias("description"))
    return own.join(kept, ["query", "rank"], "left").withColumn("snippets", F.coalesce("snippets", F.array().cast("array<string>")))


def crawled(found: DataFrame, pages: DataFrame, min_pages: int) -> DataFrame:
    """Adds text and page to results(): the text of the first min_pages results of each question that can be read (pages: url,
    html), numbered from 1; blocked, walled and empty pages count as unread. Others have nulls there."""
    texts = pages.select("url", page_text("html").alias("__t")).where(~blocked("__t")).select("url", F.substring("__t", 1, PAGE_CHARS).alias("__t")).dropDuplicates(["url"])
    read = found.join(texts, "url", "left")
    k = F.row_number().over(Window.partitionBy("query", F.col("__t").isNull()).orderBy("rank"))
    own = read.withColumn("page", F.when(F.col("__t").isNotNull(), k)).withColumn("page", F.when(F.col("page") <= min_pages, F.col("page")))
    return own.withColumn("text", F.when(F.col("page").isNotNull(), F.col("__t"))).drop("__t")


def research_block(rows: DataFrame, min_pages: int) -> DataFrame:
    """(query, block): the pages of crawled() with their summaries, a note if they are fewer than wanted, and up to five more
    results with what their search said. A question has no more rows than results, so its text is bounded."""
    snip = F.when(F.col("description") != "", F.col("description")).otherwise(F.coalesce(F.get("snippets", F.lit(0)), F.lit("")))
    about = F.when(F.col("description") != "", F.concat(F.lit("SUMMARY: "), "description", F.lit("\n\n"))).otherwise("")
    page = F.concat(F.lit("===== PAGE "), "page", F.lit(" =====\nTITLE: "), "title", F.lit("\nURL: "), "url", F.lit("\n\n"), about, "text")
    line = F.concat(F.lit("- "), "title", F.lit(" — "), "url", F.lit("\n  "), snip)
    k = F.row_number().over(Window.partitionBy("query", F.col("page").isNull()).orderBy("rank"))
    own = rows.withColumns({"__page": F.when(F.col("page").isNotNull(), F.struct("page", page.alias("t"))), "__more": F.when(F.col("page").isNull() & (k <= EXTRAS), F.struct("rank", line.alias("t")))})
    joined = own.groupBy("query").agg(F.array_sort(F.collect_list("__page")).alias("pages"), F.array_sort(F.collect_list("__more")).alias("more"))
    n = F.size("pages")
    note = F.when(n < min_pages, F.format_string(f"\n\n(NOTE: only %d of the target {min_pages} pages could be fully crawled; the rest were login-walled, blocked, or empty.)", n)).otherwise("")
    extra = F.when(F.size("more") > 0, F.concat(F.lit("\n\nADDITIONAL SEARCH RESULTS (not fully crawled, snippets only):\n"), F.array_join(F.transform("more", lambda x: x["t"]), "\n"))).otherwise("")
    return joined.select("query", F.concat(F.array_join(F.transform("pages", lambda x: x["t"]), "\n\n"), note, extra).alias("block"))
