"""A persisted inverted index: postings by term, so that a keyword search reads only what its terms need, and blocks of postings
by impact, so that it reads of frequent terms only what can still come among the best."""

from __future__ import annotations

import re
import zlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessel.functions.text import bound, terms
from tessel.operators.retrieval import B, K1, TOP_K, best_rows, counted_each, ranked
from tessel.tables import saved, shared_dir

#: Folders that terms (and keys) are dealt out to.
BUCKETS = 64
#: Bands that impacts are cut into; postings that a term's first round reads, and how many times more each further round may read.
BANDS, FIRST, MORE = 32, 256, 8
#: New rows of a round that are broadcast; where there are more, the rows of the index are shuffled to them.
HELD = 1_000_000


def bucket(term, buckets: int = BUCKETS):
    return F.pmod(F.crc32(F.col(term).cast("binary")), F.lit(buckets)).cast("int")


def counted(chunks: DataFrame, key: str = "id", text=None) -> DataFrame:
    """(key, dl, counts: array of (term, tf)), a row for each key and length: rows that share both count as one.

    Only the terms of whole rows are shuffled, once and by key; a row's terms are counted where the row is, from the places in
    its sorted terms at which a new one begins."""
    text = text if text is not None else (F.concat_ws(" ", "context", "content") if "context" in chunks.columns else F.col("content"))
    own = chunks.select(F.col(key).alias(key), bound(terms(text), lambda t: F.struct(F.size(t).alias("dl"), t.alias("t"))).alias("f"))
    rows = own.select(key, F.col("f.dl").alias("dl"), F.col("f.t").alias("t")).groupBy(key, "dl").agg(F.flatten(F.collect_list("t")).alias("t"))

    def runs(t):
        begins = lambda n: F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(t, i) != F.get(t, F.greatest(i - 1, F.lit(0)))))
        ended = lambda at: F.transform(at, lambda i, k: F.struct(F.get(t, i).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(t)) - i).alias("tf")))
        return bound(begins(F.size(t)), ended)

    return rows.where(F.size("t") > 0).select(key, "dl", bound(F.array_sort("t"), runs).alias("counts"))


def totals_of(chunks: DataFrame, text=None) -> DataFrame:
    """One row (n, words)."""
    text = text if text is not None else (F.concat_ws(" ", "context", "content") if "context" in chunks.columns else F.col("content"))
    return chunks.select(F.size(terms(text)).alias("dl")).agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("words"))


def build(chunks: DataFrame, key: str = "id", text=None, buckets: int = BUCKETS) -> tuple[DataFrame, DataFrame]:
    """(postings: bucket, term, key, dl, tf; totals: n, words). Rows are counted where they are and written once; only those whose
    key occurs more than once meet."""
    text = text if text is not None else (F.concat_ws(" ", "context", "content") if "context" in chunks.columns else F.col("content"))
    each, rows = counted_each(chunks, None, key, text, [], shared_dir(chunks.sparkSession))
    own = rows.select(key, F.inline(F.arrays_zip(F.col("terms").alias("term"), "tf", "dl"))).withColumn("bucket", bucket("term", buckets))
    return own.select("bucket", "term", key, "dl", "tf"), each.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("words"))


def write(postings: DataFrame, totals: DataFrame, path: str) -> None:
    """Folders by bucket, sorted by term, so that readers skip folders and row groups. A term that very many rows hold is
    spread over tasks by key."""
    key = next(c for c in postings.columns if c not in ("bucket", "term", "dl", "tf"))
    postings.repartition("bucket", F.pmod(F.xxhash64(key), F.lit(8))).sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    totals.write.mode("overwrite").parquet(f"{path}/totals")


def read(spark, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/totals")


def search(postings: DataFrame, totals: DataFrame, queries: Sequence[str] | DataFrame, top_k: int = TOP_K, key: str = "id", buckets: int = BUCKETS) -> DataFrame:
    """(query, key, score, rank), as a scan of the chunks would give. queries: texts, or a table (query, q) of any size.

    Rows of the index are joined by bucket and term, so a table of questions prunes the buckets that no term of theirs is in
    (dynamic partition pruning), and a list by plain filters. What is asked for of a row is gathered once and scored as a scan's rows
    are, so the pairs of a frequent term's rows and its queries are never rows of their own."""
    spark, folder = postings.sparkSession, shared_dir(postings.sparkSession)
    own = postings
    if not isinstance(queries, DataFrame):
        queries = [q for q in queries if q and q.strip()]
        wanted = sorted({t for q in queries for t in re.findall("[a-z0-9]+", q.lower())})
        queries = spark.createDataFrame(list(enumerate(queries)), "query int, q string")
        own = own.where(F.col("bucket").isin(*sorted({zlib.crc32(t.encode()) % buckets for t in wanted})) & F.col("term").isin(*wanted)) if wanted else own.where(F.lit(False))
    asked = saved(queries.select("query", F.explode(F.array_distinct(terms("q"))).alias("term")).distinct(), folder, "asked")
    own = own.join(asked.select("term").distinct().withColumn("bucket", bucket("term", buckets)), ["bucket", "term"], "left_semi")
    at = F.collect_list(F.struct("term", F.col("tf").cast("int").alias("tf"), F.col("dl").cast("int").alias("dl")))
    rows = saved(own.groupBy(key).agg(at.alias("p")).select(key, F.col("p.term").alias("terms"), "p.tf", "p.dl"), folder, "rows")
    df = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    mean = F.when(F.col("words") > 0, F.col("words") / F.col("n")).otherwise(1.0)
    stats = saved(df.join(F.broadcast(totals)).select("term", "df", "n", mean.alias("avgdl")), folder, "stats")  # totals are one row
    return best_rows(rows, stats, asked, top_k, key)


def build_blocks(postings: DataFrame, totals: DataFrame, key: str = "id") -> dict[str, DataFrame]:
    """blocks_of() of postings that are at hand one by one."""
    return blocks_of(postings.groupBy(key, "dl").agg(F.collect_list(F.struct("term", "tf")).alias("counts")), totals, key)


def blocks_of(rows: DataFrame, totals: DataFrame, key: str = "id") -> dict[str, DataFrame]:
    """The tables of an index by impact, from counted rows. A posting's impact is what BM25 makes of its frequency and length, without
    the weight of its term. `docs`: (no, key, impacts), each row's impacts by term; `blocks`: (bucket, term, band, no), the rows
    of each term in each band of impacts; `bands`: (bucket, term, band, n, most), their number and the highest impact of them;
    `totals` as given. no is a 32-bit hash of the key: where two keys share one both are read and scored, each by its own impacts.

    Bands are fixed ranges, so none sorts the postings of a frequent term in one task. Lengths are weighed by the mean of
    `totals`: build the index anew when that has moved."""
    mean = totals.select(F.when(F.col("words") > 0, F.col("words") / F.col("n")).otherwise(1.0).alias("avgdl"))  # one row
    impact = lambda c: c["tf"] * (K1 + 1) / (c["tf"] + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    docs = rows.join(F.broadcast(mean)).select(F.hash(key).alias("no"), key, F.map_from_entries(F.transform("counts", lambda c: F.struct(c["term"], impact(c)))).alias("impacts"))
    return {"docs": docs, "totals": totals} | _by_impact(docs)


def _by_impact(docs: DataFrame) -> dict[str, DataFrame]:
    rows = docs.select("no", F.explode("impacts").alias("term", "impact")).withColumn("bucket", bucket("term"))
    rows = rows.withColumn("band", F.greatest(F.lit(0), F.least(F.lit(BANDS - 1), F.floor((1 - F.col("impact") / (K1 + 1)) * BANDS))).cast("int"))
    bands = rows.groupBy("bucket", "term", "band").agg(F.count("*").alias("n"), F.max("impact").alias("most"))
    return {"bands": bands, "blocks": rows.select("bucket", "term", "band", "no")}


def write_blocks(index: dict[str, DataFrame], path: str) -> None:
    """Rows first; bands and blocks are made of the written rows. A term that very many rows hold is spread over tasks by row."""
    spark = index["docs"].sparkSession
    packed = lambda df: df.write.mode("overwrite").option("compression", "zstd")
    packed(index["docs"]).parquet(f"{path}/docs")
    index["totals"].write.mode("overwrite").parquet(f"{path}/totals")
    for name, by in (("bands", "term"), ("blocks", "no")):
        own = _by_impact(spark.read.schema(index["docs"].schema).parquet(f"{path}/docs"))[name]
        packed(own.repartition("bucket", F.pmod(F.xxhash64(by), F.lit(8))).sortWithinPartitions("bucket", "term", "band")).partitionBy("bucket").parquet(f"{path}/{name}")


def read_blocks(spark, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in ("bands", "blocks", "docs", "totals")}


def search_blocks(index: dict[str, DataFrame], queries: Sequence[str] | DataFrame, top_k: int = TOP_K, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """((query, key, score, rank), (query, term, n)): what `search` gives, and how many postings each query read of each term.

    Rounds raise a threshold: each reads, of each term of the queries that are still open, the blocks of highest impact until a
    number of postings, scores the new rows in full by their own impacts, and closes the queries whose top_k-th score is above
    what an unread row could reach: the sum of the terms' weights times the highest impact of their next band. A term that most rows
    hold weighs little, so its later bands stay unread. Terms without postings read nothing; blank queries give nothing."""
    spark, folder = index["blocks"].sparkSession, shared_dir(index["blocks"].sparkSession)
    if not isinstance(queries, DataFrame):
        queries = spark.createDataFrame(list(enumerate(q for q in queries if q and q.strip())), "query int, q string")
    asked = queries.select("query", F.explode(F.array_distinct(terms("q"))).alias("term")).distinct().withColumn("bucket", bucket("term"))
    bands = index["bands"].join(asked.select("bucket", "term").distinct(), ["bucket", "term"], "left_semi")
    n, df = F.col("totals_n"), F.col("df")
    idf = bands.groupBy("bucket", "term").agg(F.sum("n").alias("df")).join(F.broadcast(index["totals"].select(F.col("n").alias("totals_n"))))
    idf = idf.select("bucket", "term", F.log(1 + (n - df + 0.5) / (df + 0.5)).alias("idf"))
    by_band = Window.partitionBy("query", "term").orderBy("band")
    todo = asked.join(idf, ["bucket", "term"]).join(bands, ["bucket", "term"])
    todo = saved(todo.withColumn("before", F.coalesce(F.sum("n").over(by_band.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))), folder, "todo")
    weights = todo.groupBy("query").agg(F.collect_set(F.struct("term", "idf")).alias("weights"))
    # rows of one key and different lengths add up
    of_key = lambda s: s.groupBy("query", key).agg(F.sum("score").alias("score"))
    still, scored, low, turn = todo.select("query").distinct(), None, 0, 0
    while True:
        high = FIRST * MORE**turn
        now = todo.join(still, "query", "left_semi").where((F.col("before") >= low) & (F.col("before") < high)).select("query", "bucket", "term", "band")
        met = now.join(index["blocks"], ["bucket", "term", "band"]).select("query", "no").distinct()
        new = saved(met if scored is None else met.join(scored, ["query", "no"], "left_anti"), folder, f"new{turn}")
        full = index["docs"].join(F.broadcast(new) if new.count() <= HELD else new, "no").join(weights, "query")
        score = F.aggregate("weights", F.lit(0.0), lambda s, w: s + w["idf"] * F.coalesce(F.element_at("impacts", w["term"]), F.lit(0.0)))
        fresh = saved(full.select("query", "no", key, score.alias("score")), folder, f"scored{turn}")
        scored = fresh if scored is None else scored.unionByName(fresh)
        best = ranked(of_key(scored), ["query"], top_k, key).where(F.col("rank") == top_k - 1).select("query", F.col("score").alias("least"))
        ahead = todo.join(still, "query", "left_semi").where(F.col("before") >= high).groupBy("query", "term", "idf").agg(F.max("most").alias("most"))
        ahead = ahead.groupBy("query").agg(F.sum(F.col("idf") * F.col("most")).alias("reach"))
        still = saved(ahead.join(best, "query", "left").where(F.col("least").isNull() | (F.col("reach") >= F.col("least") - 1e-8)).select("query"), folder, f"still{turn}")
        saved(now.join(todo, ["query", "bucket", "term", "band"]).groupBy("query", "term").agg(F.sum("n").alias("n")), folder, f"read/turn={turn}")
        if still.isEmpty():
            break
        low, turn = high, turn + 1
    reads = spark.read.schema("query " + scored.schema["query"].dataType.simpleString() + ", term string, n long").parquet(f"{folder}/read").groupBy("query", "term").agg(F.sum("n").alias("n"))
    return ranked(of_key(scored).where("score > 0"), ["query"], top_k, key), reads
