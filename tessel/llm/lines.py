"""Line dedup: a sharded minimal perfect hash over repeated lines, probed for the documents.

The first pass writes a 128-bit digest for each line key of each document. Digests found in two or more documents go to
shards by one half of the digest. A shard is indexed by a minimal perfect hash over the other half, whose slots point into
arrays of fingerprints (the first half), document counts and smallest ids. Then every document's digests are sent to the
shard that they belong to: a task opens each of its shards once, probes the arrays, and answers only with the digests that
the document loses. Lines are never joined with lines, and the work is in proportion to the input whatever the number of
shards: no task ever reads more of the index than the shards it was dealt.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, documents, large_batches, qualified, saved, shared_dir, small_batches, unused

MIN_CHARS = 10
#: Digests of a shard at most, about; 28 bytes each with everything.
SHARD = 500_000
_NO_ID = np.iinfo(np.int64).max


# ---- the minimal perfect hash


def _mix(keys: np.ndarray, level: int) -> np.ndarray:
    """A multiply-and-shift mix of 64-bit keys that differs from level to level."""
    x = keys + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Maps n distinct 64-bit keys to 0 .. n-1, each to its own slot, with a few bits a key; other keys get any slot or -1.

    Level by level, keys that fall on a bit alone set it and the others go on to the next level; a key's slot is the rank
    of its bit. After the last level what is left (next to nothing) is kept as a sorted list.
    """

    LEVELS, ROOM = 24, 2

    def __init__(self, words: list[np.ndarray], rest: np.ndarray) -> None:
        self.words, self.rest, before, self.ranks = words, rest, 0, []
        for w in words:
            sums = np.cumsum(np.bitwise_count(w), dtype=np.int64)
            self.ranks.append(before + np.concatenate(([0], sums[:-1])) if len(w) else sums)
            before += int(sums[-1]) if len(w) else 0
        self.before_rest = before

    @classmethod
    def build(cls, keys: np.ndarray) -> "PerfectHash":
        words, left = [], keys
        for level in range(cls.LEVELS):
            if not left.size:
                break
            size = -(-max(64, cls.ROOM * left.size) // 64) * 64
            at = (_mix(left, level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            words.append(np.packbits(alone, bitorder="little").view(np.uint64))
            left = left[~alone[at]]
        return cls(words, np.sort(left))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        out, todo = np.full(keys.size, -1, dtype=np.int64), np.arange(keys.size)
        for level, (w, rank) in enumerate(zip(self.words, self.ranks)):
            at = _mix(keys[todo], level) % np.uint64(len(w) * 64)
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            hit = (w[word] >> bit & np.uint64(1)).astype(bool)
            below = w[word[hit]] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[todo[hit]] = rank[word[hit]] + np.bitwise_count(below)
            todo = todo[~hit]
            if not todo.size:
                return out
        if self.rest.size:
            k = np.minimum(np.searchsorted(self.rest, keys[todo]), self.rest.size - 1)
            same = self.rest[k] == keys[todo]
            out[todo[same]] = self.before_rest + k[same]
        return out


# ---- lines


def line_key(line: bytes) -> bytes | None:
    """The line without ASCII white space at its ends, A-Z lower-cased; None if it has fewer than MIN_CHARS code points."""
    key = line.strip().lower()
    if len(key) < MIN_CHARS or len(key) < 4 * MIN_CHARS and len(key.decode("utf-8", "replace")) < MIN_CHARS:
        return None
    return key


def _digests(keys: list[bytes]) -> np.ndarray:
    """(n, 2) signed halves of XXH3-128."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), dtype=np.int64).reshape(-1, 2)


def line_digests(docs: DataFrame) -> DataFrame:
    """(doc, text, t) -> (h1, h2, doc, text): the digests of each row's distinct line keys. doc and text name the row."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            found, sizes = [], []
            for t in b.column(2).cast(pa.binary()).to_pylist():
                keys = {k for line in (t or b"").split(b"\n") if (k := line_key(line)) is not None}
                found += keys
                sizes.append(len(keys))
            h = _digests(found)
            rows = np.repeat(np.arange(len(sizes)), sizes)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(h[:, 0])), pa.array(np.ascontiguousarray(h[:, 1])), b.column(0).take(pa.array(rows)), b.column(1).take(pa.array(rows))], names=["h1", "h2", "doc", "text"])

    return docs.mapInArrow(run, "h1 long, h2 long, doc long, text long")


def line_counts(lines: DataFrame) -> DataFrame:
    """(h1, h2, first, docs) of the digests that at least two documents hold: the smallest id and the number of holders."""
    seen = lines.groupBy("h1", "h2").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.count("*").alias("docs"))
    return seen.where("first < last").select("h1", "h2", "first", "docs")


def build_index(repeated: DataFrame, folder: str, shard_size: int = SHARD) -> tuple[str, int]:
    """Writes the index of (h1, h2, first, docs) as one binary row for each shard; returns its path and shard count.

    Digests that differ in the fingerprint alone cannot share a slot: they are kept beside the arrays, whole.
    """
    table = saved(repeated, folder, "repeated")
    shards = max(1, -(-table.count() // shard_size))

    def build(group: pa.Table) -> pa.Table:
        h1, h2, first, docs = (group.column(c).to_numpy() for c in ("h1", "h2", "first", "docs"))
        _, place, times = np.unique(h2, return_inverse=True, return_counts=True)
        alone = times[place] == 1
        twins = np.stack([x[~alone] for x in (h1, h2, first)])
        h1, h2, first, docs = (x[alone] for x in (h1, h2, first, docs))
        mph = PerfectHash.build(h2.view(np.uint64))
        at = mph.slots(h2.view(np.uint64))
        arrays = [np.zeros(len(h1), kind) for kind in (np.int64, np.uint32, np.int64)]
        for out, values in zip(arrays, (h1, np.minimum(docs, 2**32 - 1), first)):
            out[at] = values
        binary = {"words": b"".join(w.tobytes() for w in mph.words), "rest": mph.rest.tobytes(), "fingerprints": arrays[0].tobytes(), "counts": arrays[1].tobytes(), "firsts": arrays[2].tobytes(), "twins": twins.tobytes()}
        return pa.table({"shard": group.column("shard").slice(0, 1), "levels": pa.array([[len(w) for w in mph.words]], pa.list_(pa.int64())), **{k: [v] for k, v in binary.items()}})

    dealt = table.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int"))
    index = dealt.groupBy("shard").applyInArrow(build, "shard int, levels array<bigint>, words binary, rest binary, fingerprints binary, counts binary, firsts binary, twins binary")
    path = qualified(repeated.sparkSession, f"{folder}/index")
    index.write.mode("overwrite").partitionBy("shard").parquet(path)
    discard(repeated.sparkSession, f"{folder}/repeated")
    return path, shards


def shards_of(spark: SparkSession, path: str) -> frozenset[int]:
    """The shards that an index has; the folder itself must be there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    return frozenset(int(name.removeprefix("shard=")) for f in found if (name := f.getPath().getName()).startswith("shard="))


class Shard:
    """The arrays of one shard."""

    def __init__(self, row: dict) -> None:
        words, cuts = np.frombuffer(row["words"], np.uint64), np.cumsum(row["levels"])[:-1].astype(np.int64)
        self.hash = PerfectHash(np.split(words, cuts) if row["levels"] else [], np.frombuffer(row["rest"], np.uint64))
        self.fingerprints, self.counts, self.firsts = (np.frombuffer(row[c], kind) for c, kind in (("fingerprints", np.int64), ("counts", np.uint32), ("firsts", np.int64)))
        self.twins = np.frombuffer(row["twins"], np.int64).reshape(3, -1)

    def first_docs(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which digests are of repeated lines, the smallest id that holds each of them)."""
        at = self.hash.slots(h2.view(np.uint64))
        good, first = at >= 0, np.zeros(len(h1), dtype=np.int64)
        good[good] = (self.fingerprints[at[good]] == h1[good]) & (self.counts[at[good]] > 1)
        first[good] = self.firsts[at[good]]
        for a, b, smallest in self.twins.T:
            same = (h1 == a) & (h2 == b)
            good |= same
            first[same] = smallest
        return good, first


class LineIndex:
    """Reads shards from the shared folder, by its qualified path. One is held at a time: who asks in order of shards opens each
    once. `shards` are those that were written: one of them that cannot be read is an error, any other has no repeated line."""

    def __init__(self, path: str, shards: frozenset[int]) -> None:
        self.fs, self.root = pyarrow.fs.FileSystem.from_uri(path)
        self.shards = shards
        self.at, self.held, self.loads = None, None, 0

    def shard(self, k: int) -> Shard | None:
        """The shard, or None if no repeated line belongs to it."""
        if k != self.at:
            self.at, self.held = k, Shard(pq.read_table(f"{self.root}/shard={k}", filesystem=self.fs, partitioning=None).to_pylist()[0]) if k in self.shards else None
            self.loads += 1
        return self.held


def probe(index: LineIndex, batches):
    """Rows (shard, h1, h2, doc, text) in order of shards -> (doc, text, h1, h2) of those whose line a smaller id holds too."""
    for b in batches:
        shard, h1, h2, doc, text = (b.column(k).to_numpy(zero_copy_only=False) for k in range(5))
        cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
        lost = np.zeros(len(shard), dtype=bool)
        for a, z in zip(cuts, cuts[1:]):
            if a < z and (found := index.shard(int(shard[a]))) is not None:
                repeated, first = found.first_docs(np.ascontiguousarray(h1[a:z]), np.ascontiguousarray(h2[a:z]))
                lost[a:z] = repeated & (first != doc[a:z])
        yield pa.RecordBatch.from_arrays([pa.array(x[lost]) for x in (doc, text, h1, h2)], names=["doc", "text", "h1", "h2"])


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_size: int = SHARD) -> DataFrame:
    """Adds n_lines, n_dropped and kept (the text without its repeated lines) to every row of docs; replaces columns of
    these names if docs has them.

    A key of MIN_CHARS code points or more that occurs in at least two documents loses all its lines but for those in the
    smallest id that holds it, where all stay. A null or empty text is one empty line and stays empty. Rows that share an
    id count as one document. A null id counts as larger than any other; null ids count as one document. An empty table gives an
    empty one.

    Rows are told apart by id and a hash of the text, so neither a common id nor null ids gather in one task, and digests
    of a common line are spread over tasks that each open its shard.
    """
    spark = docs.sparkSession
    folder = shared_dir(spark)
    docs = docs.drop("n_lines", "n_dropped", "kept")
    text = F.col(text_col).cast("string")
    named = {"doc": F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)), "text": F.xxhash64(text)}
    lines = saved(line_digests(docs.select(named["doc"].alias("doc"), named["text"].alias("text"), text.alias("t"))), folder, "lines")
    path, shards = build_index(line_counts(lines), folder, min_size)
    large_batches(spark)
    probes = lines.select(F.pmod("h1", F.lit(shards)).cast("int").alias("shard"), "h1", "h2", "doc", "text")
    # rebalanced by shard: Spark splits what is large, so a common line is no hot key; sorted, so that a shard is opened once
    dealt = probes.hint("rebalance", "shard").sortWithinPartitions("shard")
    there = shards_of(spark, path)
    lost = dealt.mapInArrow(lambda batches: probe(LineIndex(path, there), batches), "doc long, text long, h1 long, h2 long")
    lost = saved(lost.groupBy("doc", "text").agg(F.collect_set(F.struct("h1", "h2")).alias("gone")), folder, "lost")
    discard(spark, f"{folder}/lines")
    discard(spark, path)
    small_batches(spark)
    names = docs.columns
    at, lost_at = names.index(text_col), len(names)
    doc, of_text, gone = (unused(f"line_{k}", docs) for k in ("doc", "text", "gone"))
    own, lost = docs.withColumns({doc: named["doc"], of_text: named["text"]}), lost.select(F.col("doc").alias(doc), F.col("text").alias(of_text), F.col("gone").alias(gone))
    marked = own.join(lost, [doc, of_text], "left").select(*[f"`{c}`" for c in names], gone)

    def run(batches):
        for b in batches:
            n_lines, n_dropped, kept = [], [], []
            gone = b.column(lost_at)
            flat, offsets = gone.flatten(), np.concatenate(([0], np.cumsum(gone.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))))
            pairs = np.stack([flat.field(k).to_numpy(zero_copy_only=False) for k in range(2)], axis=1).astype(np.int64).tobytes()
            for k, t in enumerate(b.column(at).cast(pa.string()).cast(pa.binary()).to_pylist()):
                own = (t or b"").split(b"\n")
                out = {pairs[i : i + 16] for i in range(16 * int(offsets[k]), 16 * int(offsets[k + 1]), 16)}
                stay = [x for x in own if (key := line_key(x)) is None or xxhash.xxh3_128_digest(key) not in out] if out else own
                n_lines.append(len(own))
                n_dropped.append(len(own) - len(stay))
                kept.append(b"\n".join(stay))
            yield pa.RecordBatch.from_arrays([*b.columns[:lost_at], pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=[*b.schema.names[:lost_at], "n_lines", "n_dropped", "kept"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "n_lines long, n_dropped long, kept string"])
    return marked.mapInArrow(run, schema)


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH lines AS (
  SELECT doc_id, pos, line, regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '') AS bare
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS pos FROM documents)
), keyed AS (
  SELECT doc_id, pos, line, translate(bare, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), repeated AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT k.doc_id, k.pos, k.line, r.first IS NOT NULL AND r.first <> k.doc_id AS gone
  FROM keyed k LEFT JOIN repeated r ON k.key = r.key
)
SELECT doc_id, count(*) AS n_lines, sum(gone::int)::bigint AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN NOT gone THEN line END, chr(10) ORDER BY pos), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
