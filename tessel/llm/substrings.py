"""Substring dedup: every byte of a string of LENGTH bytes that also starts earlier goes.

Repeats are found by suffix order: the Burrows-Wheeler transform of a collection and its common prefixes, built column by
column over external files (transform.py). No collection may hold the whole corpus, so each window of LENGTH bytes goes to a
bucket by its own content, the smallest hash of the KGRAM-byte strings in it: equal windows share a bucket, and neighbours
mostly do, so what is dealt out are short segments (at most SPAN windows) of texts. Equal segments are folded together before
and after the shuffle by a 96-bit digest of their bytes; the first of each, where its bucket holds another segment or it
repeats within, is looked at by a collection. Buckets that very many texts share are cut further by the second smallest hash.

A row of the table is named by its id and a hash of its text, so rows that share an id, or have none, are told apart, and no
key holds more rows than are equal. Buckets that very many rows share are told from a sample of the rows and dealt out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, documents, draw, large_batches, saved, shared_dir, small_batches
from .transform import repeated_windows

LENGTH, KGRAM = 100, 24
#: Windows of a segment at most: no more than share one place of the smallest hash.
SPAN = LENGTH - KGRAM + 1
#: Segments of a collection, about; of a bucket that is not cut by a second hash; and of one that one collection takes:
#: larger ones are dealt out by pairs of blocks.
COLLECTION, HOT, BLOCK = 8_000, 1_000, 12_000
#: Rows of a bucket, about, from which on it is dealt out over tasks; the part of the rows from which that is told.
WIDE, SAMPLE = 100_000, 64
#: Bytes before and after the string of the smallest hash: a window that holds it has these on its sides in one of the ways
#: at least (as many as SPAN - 1 in all, short of what lies between two ways).
SIDES = [(k * (SPAN - 1) // 4, SPAN - 1 - (k + 1) * (SPAN - 1) // 4 + (k < 3)) for k in range(4)]
#: Segments that a task folds together at a time.
FOLD = 400_000
_NO_ID = np.iinfo(np.int64).max
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


# ---- windows and segments


def _gram_hashes(b: np.ndarray) -> np.ndarray:
    """A hash of the KGRAM bytes from each place on, put together from shorter ones of doubling length."""
    with np.errstate(over="ignore"):
        size, factor, parts = 1, _ODD[1], [(1, _ODD[1], b.astype(np.uint64) * _ODD[0] + np.uint64(1))]
        while size * 2 <= KGRAM:
            h = parts[-1][2]
            h = h[:-size] * factor + h[size:]
            size, factor = size * 2, factor * factor
            parts.append((size, factor, h))
        size, _, h = parts[-1]
        for n, factor, own in reversed(parts):
            while size + n <= KGRAM:
                keep = len(b) - size - n + 1
                h, size = h[:keep] * factor + own[size : size + keep], size + n
        h = (h ^ h >> np.uint64(32)) * _ODD[2]
        return h ^ h >> np.uint64(29)


def _window_minima(h: np.ndarray) -> np.ndarray:
    """The smallest of the SPAN hashes from each place on."""
    size, m = 1, h
    while size * 2 <= SPAN:
        m, size = np.minimum(m[:-size], m[size:]), size * 2
    rest = SPAN - size
    return np.minimum(m[:-rest], m[rest:]) if rest else m


def segments(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, windows, bucket, again) of the segments of a text; again: its smallest hash occurs in it more than once."""
    if len(text) < LENGTH:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none.astype(bool)
    h = _gram_hashes(np.frombuffer(text, np.uint8))
    m = _window_minima(h)
    starts = np.concatenate(([0], np.flatnonzero(m[1:] != m[:-1]) + 1))
    sizes = np.diff(np.append(starts, m.size))
    parts = -(-sizes // SPAN)
    if parts.max() > 1:
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        starts, left = np.repeat(starts, parts) + nth * SPAN, np.repeat(sizes, parts) - nth * SPAN
        sizes = np.minimum(left, SPAN)
    # the places of each segment that hold its smallest hash
    least = m[starts]
    width = sizes + SPAN - 1
    at = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width - starts, width)
    again = np.add.reduceat(h[at] == np.repeat(least, width), np.cumsum(width) - width) > 1
    return starts, sizes, least.view(np.int64), again


#: A segment's row: its bucket, the digest of its bytes (in two parts), the row of the table (in two), place, size and kind.
_TYPES = {"bucket": "long", "same": "long", "more": "int", "doc": "long", "text": "long", "start": "int", "windows": "int", "kind": "int"}
_SEGMENT = ", ".join(f"{k} {v}" for k, v in _TYPES.items())
_ARROW = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
#: Kinds of a segment's row: first of its bytes (so far), first and repeating within, and not first.
FIRST, WITHIN, COPY = 0, 1, 2


def _batch(cols, schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[k]) for c, k in zip(cols, kinds)], names=list(names))


def _changes(*cols: np.ndarray) -> np.ndarray:
    """Which rows differ from the one before; the first does."""
    new = np.ones(len(cols[0]), dtype=bool)
    new[1:] = False
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    return new


def _fold(cols: list[np.ndarray]) -> list[np.ndarray]:
    """Sorted by bytes and place; what follows an equal segment at another place becomes a copy."""
    bucket, same, more, doc, text, start, windows, kind = cols
    order = np.lexsort((start, text, doc, more, same))
    bucket, same, more, doc, text, start, windows, kind = (x[order] for x in (bucket, same, more, doc, text, start, windows, kind))
    new = _changes(same, more)
    first = np.flatnonzero(new)[np.cumsum(new) - 1] if len(new) else np.zeros(0, np.int64)
    elsewhere = (doc != doc[first]) | (text != text[first]) | (start != start[first])
    return [bucket, same, more, doc, text, start, windows, np.where(elsewhere, COPY, kind)]


def _segment_rows(docs: DataFrame) -> DataFrame:
    """(doc, text, t) -> the segments of every text."""
    small_batches(docs.sparkSession)

    def run(batches):
        rows, n = [], 0
        for b in batches:
            for doc, name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist()):
                start, windows, bucket, again = segments(text or b"")
                if not len(start):
                    continue
                digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(text[s : s + k + LENGTH - 1]) for s, k in zip(start.tolist(), windows.tolist())), np.int64).reshape(-1, 2)
                rows.append((bucket, digest[:, 0], digest[:, 1] >> 32, np.full(len(start), doc, np.int64), np.full(len(start), name, np.int64), start, windows, again.astype(np.int64)))
                n += len(start)
                if n >= FOLD:
                    yield _batch(_fold([np.concatenate(x) for x in zip(*rows)]), _SEGMENT)
                    rows, n = [], 0
        if rows:
            yield _batch(_fold([np.concatenate(x) for x in zip(*rows)]), _SEGMENT)

    return docs.mapInArrow(run, _SEGMENT)


_SETTLED = "bucket long, doc long, text long, start int, windows int, open boolean"


def _settle(batches):
    """Over rows sorted by bucket, bytes and place: (bucket, doc, text, start, windows, open). What follows an equal segment is
    settled; firsts are open if their bucket has another first or they repeat within."""
    held = None
    prev = None
    place = (0, 3, 4, 5, 6)  # bucket, doc, text, start, windows
    for b in batches:
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in range(8)]
        if not len(cols[0]):
            continue
        # the last first that was seen, ahead of this batch's rows
        ahead = prev is not None
        if ahead:
            cols = [np.concatenate(([p], x)) for p, x in zip(prev, cols)]
        bucket, same, more, doc, text, start, windows, kind = cols
        live = kind != COPY
        rows = np.flatnonzero(live)
        new = _changes(bucket[rows], same[rows], more[rows]) if len(rows) else np.ones(0, dtype=bool)
        lead = rows[new][np.cumsum(new) - 1] if len(rows) else rows
        copies = rows[(doc[rows] != doc[lead]) | (text[rows] != text[lead]) | (start[rows] != start[lead])]
        firsts = rows[new]
        done = np.concatenate((copies, np.flatnonzero(~live)))
        other = np.zeros(len(firsts), dtype=bool)
        other[1:] |= bucket[firsts[1:]] == bucket[firsts[:-1]]
        other[:-1] |= bucket[firsts[1:]] == bucket[firsts[:-1]]
        is_open = other | (kind[firsts] == WITHIN)
        if held is not None and ahead and len(firsts) and firsts[0] == 0:
            is_open[0] |= held
        if len(firsts):  # the last first waits for the next batch
            last = firsts[-1]
            prev, held = tuple(x[last] for x in cols), bool(is_open[-1])
            firsts, is_open = firsts[:-1], is_open[:-1]
        found = np.concatenate((firsts[is_open], done))
        yield _batch([*(cols[k][found] for k in place), np.arange(len(found)) < is_open.sum()], _SETTLED)
    if prev is not None and held:
        yield _batch([*(np.array([prev[k]]) for k in place), np.array([True])], _SETTLED)


def _second(bucket: int, text: bytes) -> list[tuple[int, int, int]]:
    """(hash, offset, windows): the windows of a segment by the smallest hash but the bucket's own. Equal windows agree on
    that too, so a bucket that many texts share comes apart by what is around. A segment without another hash stays."""
    h = _gram_hashes(np.frombuffer(text, np.uint8))
    none = np.iinfo(np.uint64).max
    m = _window_minima(np.where(h.view(np.int64) == bucket, none, h))
    starts = np.concatenate(([0], np.flatnonzero(m[1:] != m[:-1]) + 1))
    sizes = np.diff(np.append(starts, m.size))
    keys = np.where(m[starts] == none, np.int64(bucket), m[starts].view(np.int64))
    return list(zip(keys.tolist(), starts.tolist(), sizes.tolist()))


_CUT = "bucket long, part long, doc long, text long, start int, bytes binary"


def _cut_segments(batches):
    """(doc, text, t, segments) -> (bucket, part, doc, text, start, bytes) of each segment, of hot ones by their second hash."""
    for b in batches:
        rows = []
        for doc, name, text, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), b.column(3).to_pylist()):
            for s in own:
                bucket, start, part = s["bucket"], s["start"], text[s["start"] : s["start"] + s["windows"] + LENGTH - 1]
                if s["hot"]:
                    rows += [(k, bucket, doc, name, start + a, part[a : a + n + LENGTH - 1]) for k, a, n in _second(bucket, part)]
                else:
                    rows.append((bucket, 0, doc, name, start, part))
        yield _batch([[r[k] for r in rows] for k in range(6)], _CUT)


_FOUND = "doc long, text long, start int, windows int"


def _collections(batches):
    """Over rows sorted by bucket, part and pair: runs of repeated windows, from collections of whole buckets (or whole pairs
    of blocks)."""
    names = ("bucket", "part", "pair", "doc", "text", "start", "bytes")
    held: list[list] = [[] for _ in names]
    for b in batches:
        for own, k in zip(held, range(len(names))):
            own += b.column(k).to_pylist()
        if len(held[0]) >= COLLECTION:
            last = tuple(x[-1] for x in held[:3])
            cut = next((k for k in range(len(held[0]) - 1, -1, -1) if (held[0][k], held[1][k], held[2][k]) != last), -1) + 1
            if cut:
                yield _repeats(held[0][:cut], *(x[:cut] for x in held[3:]))
                held = [x[cut:] for x in held]
    if held[0]:
        yield _repeats(held[0], *held[3:])


def _comparable(buckets: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """Which segments may share a window with another or repeat one within: those that hold the string of the bucket's hash
    with the same bytes on its sides, in one of the ways of SIDES, as another of the bucket, and those that hold it twice."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    flat = np.frombuffer(b"".join(texts), np.uint8)
    own = np.repeat(np.arange(len(texts)), sizes)
    h = _gram_hashes(flat).view(np.int64)
    at = np.flatnonzero((h == buckets[own[: h.size]]) & (np.arange(h.size) + KGRAM <= ends[own[: h.size]]))
    text = own[at]
    out = np.bincount(text, minlength=len(texts)) > 1
    begins = ends - sizes
    for before, after in SIDES:
        inside = (at - before >= begins[text]) & (at + KGRAM + after <= ends[text])
        t, low = text[inside], (at - before - begins[text])[inside]
        names = np.array([xxhash.xxh3_64_intdigest(texts[k][a : a + before + KGRAM + after]) for k, a in zip(t.tolist(), low.tolist())], dtype=np.uint64)
        _, group, count = np.unique(names, return_inverse=True, return_counts=True)
        out[t[count[group] > 1]] = True
    return out


def _repeats(buckets: list[int], docs: list[int], names: list[int], starts: list[int], texts: list[bytes]):
    rows = sorted({(d, n, s): (b, t) for b, d, n, s, t in zip(buckets, docs, names, starts, texts)}.items())
    worth = _comparable(np.array([b for _, (b, _) in rows], dtype=np.int64), [t for _, (_, t) in rows])
    rows = [r for r, w in zip(rows, worth.tolist()) if w]
    text, offset = repeated_windows([t for _, (_, t) in rows], LENGTH)
    at = np.flatnonzero(_changes(text, offset - np.arange(len(offset)))) if len(text) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(at, len(text)))
    place = np.array([k for k, _ in rows], dtype=np.int64).reshape(-1, 3)[text[at]]
    return _batch([place[:, 0], place[:, 1], place[:, 2] + offset[at], sizes], _FOUND)


# ---- the operator


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, doc, text, t): doc and text name a row; a null id comes after all others."""
    text, own = F.col(text_col).cast("string"), F.col(id_col).cast("long")
    return docs.select(own.alias("doc_id"), F.coalesce(own, F.lit(_NO_ID)).alias("doc"), F.xxhash64(text).alias("text"), text.alias("t"))


def repeated_runs(docs: DataFrame, folder: str) -> DataFrame:
    """(doc, text, t) -> (doc, text, start, windows): runs of windows that also start earlier."""
    spark = docs.sparkSession
    own = docs.select("doc", "text", "t")
    some = _segment_rows(own.where(draw("wide", "doc", "text") < F.lit(1 / SAMPLE)))
    wide = saved(some.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") * SAMPLE > WIDE).select("bucket", F.lit(True).alias("wide")), folder, "wide")
    rows = _segment_rows(own)
    # copies are settled already: any partition will do
    where = F.when(F.col("kind") == COPY, F.xxhash64("doc", "text", "start"))
    if not wide.isEmpty():
        # each of their segments has a partition by its bytes, and goes on to a collection whatever else the bucket holds
        rows = rows.join(wide, "bucket", "left").withColumn("kind", F.when((F.col("kind") == FIRST) & F.col("wide"), WITHIN).otherwise(F.col("kind")))
        where = where.when(F.col("wide"), F.xxhash64("bucket", "same"))
    dealt = rows.repartition(where.otherwise(F.col("bucket"))).select(*_TYPES).sortWithinPartitions(*list(_TYPES)[:6])
    settled = saved(dealt.mapInArrow(_settle, _SETTLED), folder, "settled")
    waiting = settled.where("open")
    many = waiting.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("bucket", F.lit(True).alias("hot"))
    # as a table its size is known: a small one is broadcast, a large one joins in parts that can be split
    marked = waiting.join(saved(many, folder, "many"), "bucket", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    wanted = marked.groupBy("doc", "text").agg(F.collect_list(F.struct("bucket", "start", "windows", "hot")).alias("segments"))
    # rows that are equal in id and text are one document
    cut = own.join(wanted, ["doc", "text"]).select("doc", "text", "t", "segments").mapInArrow(_cut_segments, _CUT)
    cut = saved(cut, folder, "segments")
    big = cut.groupBy("bucket", "part").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("bucket", "part", F.ceil(F.col("n") / (BLOCK / 2)).cast("int").alias("blocks"))
    if big.isEmpty():
        dealt = cut.withColumn("pair", F.lit(0).cast("long"))
    else:
        block = F.pmod(F.xxhash64("doc", "text", "start"), F.col("blocks")).cast("int")
        pairs = F.expr("transform(sequence(0, blocks - 1), x -> cast(least(x, own) as long) * blocks + greatest(x, own))")
        dealt = cut.join(big, ["bucket", "part"], "left").withColumn("own", block).withColumn("pair", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(pairs)))
    keys = ["bucket", "part", "pair"]
    sorted_ = dealt.select(*keys, "doc", "text", "start", "bytes").repartition(*keys).sortWithinPartitions(*keys)
    found = saved(sorted_.mapInArrow(_collections, _FOUND), folder, "found")
    for done in ("wide", "many", "segments"):
        discard(spark, f"{folder}/{done}")
    large_batches(spark)
    return settled.where("not open").select("doc", "text", "start", "windows").unionByName(found)


def _without(text: bytes, runs: list[dict] | None) -> tuple[int, int, int, bytes]:
    if not runs:
        return len(text), 0, 0, text
    starts = np.array([r["start"] for r in runs], dtype=np.int64)
    ends = np.minimum(starts + np.array([r["windows"] for r in runs], dtype=np.int64) + LENGTH - 1, len(text))
    delta = np.zeros(len(text) + 1, dtype=np.int32)
    np.add.at(delta, starts[starts < len(text)], 1)
    np.add.at(delta, ends[starts < len(text)], -1)
    gone = np.cumsum(delta[:-1]) > 0
    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(text) else 0
    return len(text), int(gone.sum()), spans, np.frombuffer(text, np.uint8)[~gone].tobytes()


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): for every row of docs its text's UTF-8 bytes without those covered by a
    string of LENGTH bytes that also starts earlier (in a smaller id, or earlier in the same text); kept is binary, as what
    is left of a text need not be UTF-8.

    A null text counts as empty. Rows that repeat an id and its text give repeated rows and are one document. Different texts
    under one id are documents of their own, in the order of a hash of the text; so are rows without an id, after all
    others, where equal texts are one document. Overlaps count, and strings are judged on the input. An empty table gives an
    empty one. Other columns are not read.
    """
    folder = shared_dir(docs.sparkSession)
    own = _named(docs, id_col, text_col)
    runs = repeated_runs(own, folder).groupBy("doc", "text").agg(F.collect_list(F.struct("start", "windows")).alias("runs"))
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            found = [_without(t or b"", r) for t, r in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([f[k] for f in found], pa.int64()) for k in range(3)), pa.array([f[3] for f in found], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return own.join(runs, ["doc", "text"], "left").select("doc_id", "t", "runs").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op1_substrings(spark, sf_dir: str) -> DataFrame:
    found = dedup_substrings(documents(spark, sf_dir))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
