"""Feeds that are fetched again and again: what is new, what is as before, what could not be read."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Answers of a fetch that are no failure.
FETCHED, UNCHANGED = 200, 304


def _state(good: Column, before: Column, digest: Column, status: Column) -> Column:
    same = (good & digest.eqNullSafe(before)) | (status.eqNullSafe(F.lit(UNCHANGED)) & before.isNotNull())
    return F.when(same, "same").when(good, "new").when(before.isNotNull(), "cached").otherwise("failed")


def _warning(state: Column, status: Column) -> Column:
    said = F.coalesce(status.cast("string"), F.lit("no answer"))
    return F.when(state == "cached", F.concat(F.lit("The listing read before is used: the feed could not be read ("), said, F.lit(")."))).when(state == "failed", F.concat(F.lit("The feed could not be read ("), said, F.lit(") and no listing was read before.")))


def listings(fetches: DataFrame) -> DataFrame:
    """(feed, at, state, listing, warning) of fetches (feed, at, status, body): state is new (another body than the last one), same
    (not modified, or the same bytes), cached (a failure, the listing before stands) or failed (a failure, or "not modified", without one);
    `listing` is the time of the fetch whose body is the listing in force.

    Bodies are hashed before the shuffle and do not travel. A null status is a failure, a null body an empty one; of fetches of one
    feed and time, those with the smaller status and hash come first."""
    good = F.col("status").eqNullSafe(F.lit(FETCHED))
    rows = fetches.select("feed", "at", "status", F.when(good, F.sha2(F.coalesce("body", F.lit("")), 256)).alias("__hash"))
    order = Window.partitionBy("feed").orderBy("at", "status", "__hash")
    before = F.last("__hash", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    known = rows.withColumn("__before", before).withColumn("state", _state(F.col("__hash").isNotNull(), F.col("__before"), F.col("__hash"), F.col("status")))
    since = F.last(F.when(F.col("state") == "new", F.col("at")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return known.select("feed", "at", "state", since.alias("listing"), _warning(F.col("state"), F.col("status")).alias("warning"))


def polled(stream: DataFrame) -> DataFrame:
    """The same of a stream of fetches (feed string, at long, status int, etag string, body string), with the body of new listings, and with the
    etag to ask with next.

    Spark's state holds for each feed a hash, an etag and a time, never a listing: that is in the sink, under (feed, listing). An
    unchanged snapshot has no body, so nothing is parsed or written again for it. Fetches of a feed must come in order over the batches; a batch
    that is replayed after a failure gives the same rows."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import hashlib

        digest, etag, listing = state.get if state.exists else (None, None, None)
        out = []
        for r in pd.concat(list(batches)).sort_values(["at", "status"], kind="stable").itertuples():
            body, kind = None, "failed" if digest is None else "cached"
            if r.status == FETCHED:
                text = r.body or ""
                now = hashlib.sha256(text.encode()).hexdigest()
                kind, etag = "same" if now == digest else "new", r.etag or etag
                if kind == "new":
                    digest, listing, body = now, int(r.at), text
            elif r.status == UNCHANGED and digest is not None:
                kind = "same"
            out.append((key[0], int(r.at), kind, listing, etag, None if pd.isna(r.status) else int(r.status), body))
        if digest is not None:
            state.update((digest, etag, listing))
        made = pd.DataFrame(out, columns=["feed", "at", "state", "listing", "etag", "status", "body"])
        yield made.astype({"listing": "Int64", "status": "Int32"})

    rows = stream.groupBy("feed").applyInPandasWithState(
        run, "feed string, at long, state string, listing long, etag string, status int, body string", "hash string, etag string, listing long", "append", GroupStateTimeout.NoTimeout
    )
    return rows.select("feed", "at", "state", "listing", "etag", "body", _warning(F.col("state"), F.col("status")).alias("warning"))
