"""Streams: chat messages into the index batch by batch, new feed entries once, replies parted into answer and reasoning."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessel.operators import index
from tessel.operators.chat import thread_items

_MESSAGE = ["chat", "idx", "role", "content", "intermediate"]


def _items(messages: DataFrame) -> DataFrame:
    source = [F.lit("chat_thread").alias("source_type"), F.col("chat").cast("string").alias("source_id")]
    return thread_items(messages).select(*source, F.concat(F.lit("m"), "idx").alias("item_id"), "content", F.lit("{}").alias("meta"))


def sync_messages(stream: DataFrame, log: index.ChunkStore, store: index.ChunkStore, embed, model: str, checkpoint: str, order: str = "seq"):
    """A query that keeps the index of every chat up with its messages (chat, idx, role, content, intermediate, and removed:
    true takes a message back).

    `log` (a ChunkStore with scope chat) keeps all messages, the last word on each (chat, idx). A batch is merged into it, and the
    chats that it touches are worked out anew from all their messages: the last user turn is that of the chat, not of the
    batch, so a question is indexed as soon as an answer and another question follow. Only changed items are embedded;
    items that a chat no longer has are pruned. A batch that is replayed after a failure changes nothing.

    Of several words on a message within a batch the one with the greatest `order` counts, a column of the source, and of equal
    ones, or where the source has no such column, one that takes the message back, then the greatest by its columns: never the
    order in which rows happen to be read, which a replay may change.
    """

    def batch(df: DataFrame, epoch: int) -> None:
        df = df.withColumn("removed", F.lit(False)) if "removed" not in df.columns else df
        word = ["removed", *_MESSAGE[2:]]
        rank = F.struct(*([order] if order in df.columns else []), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in word])
        last = df.groupBy("chat", "idx").agg(F.max_by(F.struct(*word), rank).alias("__word")).select("chat", "idx", *[F.col(f"__word.{c}").alias(c) for c in (*_MESSAGE[2:], "removed")])
        chats = last.select("chat").distinct()
        known = log.read()
        old = last.where(F.lit(False)).select(*_MESSAGE) if known is None else known.join(chats, "chat", "left_semi").join(last, ["chat", "idx"], "left_anti").select(*_MESSAGE)
        log.replace(chats, old.unionByName(last.where(~F.coalesce("removed", F.lit(False))).select(*_MESSAGE)))
        now = log.read()  # None where all that was ever said was taken back
        items = _items((last.where(F.lit(False)) if now is None else now.join(chats, "chat", "left_semi")).select(*_MESSAGE))
        stored = store.read()
        if stored is None:
            stored = index.chunk_items(items.limit(0)).withColumn("embedding", F.lit(None).cast("array<float>")).withColumn("model", F.lit(model))
        scopes = chats.select(F.lit("chat_thread").alias("source_type"), F.col("chat").cast("string").alias("source_id"))
        chunks = index.with_vectors(index.chunk_items(items), stored, embed, model).drop("reused")
        store.replace(scopes, chunks.select(*stored.columns))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def new_entries(stream: DataFrame, key: str = "id") -> DataFrame:
    """Each entry once, however often its feed lists it; the cache never forgets, so neither does the state."""
    return stream.dropDuplicates([key])


class ReasoningSplitter:
    """Parts a stream of text pieces into answer and reasoning; a tag may be cut anywhere between pieces."""

    TAGS = ("think", "thinking", "reasoning")

    def __init__(self, held: str = "", inside: str | None = None) -> None:
        self.held, self.inside = held, inside

    def feed(self, piece: str, last: bool = False) -> list[tuple[str, str]]:
        """(kind, text) parts that are certain by now; `last` gives out what was held back."""
        out, text = [], self.held + piece
        while text:
            tags = [f"</{self.inside}>"] if self.inside else [f"<{t}>" for t in self.TAGS]
            at, tag = min(((k, t) for t in tags if (k := text.lower().find(t)) >= 0), default=(-1, ""))
            kind = "reasoning" if self.inside else "answer"
            if at >= 0:
                out.append((kind, text[:at]))
                self.inside, text = (None if self.inside else tag[1:-1]), text[at + len(tag) :]
                continue
            keep = 0 if last else max((n for t in tags for n in range(1, len(t)) if text.lower().endswith(t[:n])), default=0)
            out.append((kind, text[: len(text) - keep]))
            self.held = text[len(text) - keep :]
            return [p for p in out if p[1]]
        self.held = ""
        return [p for p in out if p[1]]


def split_replies(stream: DataFrame) -> DataFrame:
    """(run, seq, piece, last) -> (run, seq, kind, text): the parts of each run's reply as they become certain. What is held
    back of a run lies in Spark's state until its last piece has come; pieces of a run must come in order of seq over the
    batches, within a batch they may come in any."""

    def parts(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        splitter = ReasoningSplitter(*state.get) if state.exists else ReasoningSplitter()
        rows, ended = [], False
        for r in pd.concat(list(batches)).sort_values("seq").itertuples():
            rows += [(key[0], r.seq, kind, text) for kind, text in splitter.feed(r.piece or "", bool(r.last))]
            ended = ended or bool(r.last)
        if ended:
            state.remove()
        else:
            state.update((splitter.held, splitter.inside))
        yield pd.DataFrame(rows, columns=["run", "seq", "kind", "text"])

    return stream.groupBy("run").applyInPandasWithState(parts, "run string, seq long, kind string, text string", "held string, inside string", "append", GroupStateTimeout.NoTimeout)
