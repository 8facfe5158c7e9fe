"""SimHash near-duplicates, candidates by fuzzy hashing with the binary Golay code.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits, and a key holds the codeword indices of all three (36 bits).
Between two words that differ in at most four bits there is one in the middle, at most two bits from either, so a fingerprint
emits the key of every word within two bits of it: two flips in one segment, or one flip in each of two (the pigeonholes
for the errors), decoded. The code is perfect, so most flips decode to the same codeword and about 120 keys are left of
2081 words. Fingerprints within four bits share a key for certain; within a key they are verified.

For near copies by similarity (near_copies) fingerprints are wider, as documents of similarity 0.8 differ in an eighth of
their bits: 20 pairs of segments, a key for every word within one bit of a pair. Links are verified on the shingles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, large_batches, saved, shared_dir, small_batches
from .graph import components

SHINGLE, SEED, MAX_BITS = 4, 42, 4
#: Members of a key that one task compares; larger keys are dealt out over pairs of blocks.
BLOCK = 8192
#: Large keys are told from such a part of the nodes.
SAMPLE = 64
_SEGMENTS = ((0, 23), (23, 23), (46, 18))
_GENERATOR = 0xC75


# ---- fingerprints


def shingle_hashes(text: bytes, shingle: int, seed: int) -> np.ndarray:
    """XXH64 of the word shingles in order, repeats included; of all words if they are fewer; none if there is no word."""
    words = text.lower().split()  # of bytes: only A-Z, only ASCII white space
    if not words:
        return np.zeros(0, dtype=np.uint64)
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    n = len(words) - shingle + 1
    if n <= 1:
        return np.array([digest(line, seed)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
    return np.array([digest(line[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist())], dtype=np.uint64)


def majority(hashes: np.ndarray) -> np.ndarray:
    """(rows, words) of 64-bit hashes -> words whose bits are set in over half the rows."""
    n, words = hashes.shape
    counts = np.zeros(64 * words, dtype=np.int64)
    for k in range(0, n, 255):  # sums of so few bits fit in a byte
        bits = np.unpackbits(hashes[k : k + 255].astype(">u8").view(np.uint8).reshape(-1, 8 * words), axis=1)
        counts += bits.sum(axis=0, dtype=np.uint8)
    return np.packbits(counts * 2 > n).view(">u8").astype(np.uint64)


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Majority of the bits of XXH64 over word shingles, repeats included; 0 if there is no word."""
    return int(majority(shingle_hashes(text, shingle, seed)[:, None])[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp): a row for each row of docs; fp holds the 64 bits as a signed long. A null text counts as empty."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t or b"", shingle, seed) for t in b.column(1).cast(pa.binary()).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "doc_id long, fp long")


# ---- the code


def _parities() -> np.ndarray:
    """Parity bits (remainder by the generator polynomial) of the 4096 data words."""
    rest = np.arange(4096, dtype=np.int64) << 11
    for bit in range(22, 10, -1):
        rest ^= np.where(rest >> bit & 1, _GENERATOR << (bit - 11), 0)
    return rest


def _errors(parity: np.ndarray) -> np.ndarray:
    """The error of at most three bits that each of the 2048 syndromes stands for (the code is perfect)."""
    out = np.zeros(2048, dtype=np.int64)
    bits = [1 << i for i in range(23)]
    words = bits + [a | b for i, a in enumerate(bits) for b in bits[:i]]
    words += [w | a for i, a in enumerate(bits) for j, b in enumerate(bits[:i]) for c in bits[:j] for w in (b | c,)]
    w = np.array(words, dtype=np.int64)
    out[parity[w >> 11] ^ (w & 2047)] = w
    return out


class Golay:
    """Decodes 23-bit words to the index of the nearest codeword, and lists the other indices that flips lead to.

    The code is linear: by how much an index changes with a flip depends on the syndrome of the word alone, so the lists are
    tables by syndrome. Words may be narrower; the bits that they lack are zero and never flip.
    """

    def __init__(self) -> None:
        self.parity = _parities()
        self.error = _errors(self.parity)
        self._tables: dict[tuple[int, int], np.ndarray] = {}

    def syndrome(self, words: np.ndarray) -> np.ndarray:
        return self.parity[words >> 11] ^ (words & 2047)

    def index(self, words: np.ndarray) -> np.ndarray:
        return (words ^ self.error[self.syndrome(words)]) >> 11

    def changes(self, width: int, flips: int) -> np.ndarray:
        """(2048, most): by syndrome, what an index is changed by with exactly so many flips (1 or 2) and no fewer; -1: none."""
        if (width, flips) not in self._tables:
            bits = [1 << k for k in range(width)]
            masks = np.array(bits if flips == 1 else [a | b for k, a in enumerate(bits) for b in bits[:k]], dtype=np.int64)
            own = np.arange(2048)[:, None]
            found = np.sort((masks[None, :] ^ self.error[own ^ self.syndrome(masks)[None, :]] ^ self.error[own]) >> 11, axis=1)
            found[:, 1:][found[:, 1:] == found[:, :-1]] = 0
            if flips == 2:
                found[(found[:, :, None] == self.changes(width, 1)[:, None, :]).any(axis=2)] = 0
            found = -np.sort(-found, axis=1)
            self._tables[width, flips] = np.where(found == 0, -1, found)[:, : max(1, int((found > 0).sum(axis=1).max()))]
        return self._tables[width, flips]

    def keys(self, words: list[np.ndarray], widths: list[int], flips: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, key): for each row of segments the keys of all words within so many flips (1 or 2), without repeats."""
        base, syndromes = [self.index(w) for w in words], [self.syndrome(w) for w in words]
        shifts = [12 * k for k in reversed(range(len(words)))]
        whole = sum(b << s for b, s in zip(base, shifts))
        one = [np.where((c := self.changes(n, 1)[s]) < 0, -1, c << shift) for n, s, shift in zip(widths, syndromes, shifts)]
        cols = [np.zeros((len(whole), 1), dtype=np.int64), *one]
        if flips == 2:
            cols += [np.where((c := self.changes(n, 2)[s]) < 0, -1, c << shift) for n, s, shift in zip(widths, syndromes, shifts)]
            for k, a in enumerate(one):
                for b in one[:k]:
                    both = (a[:, :, None] | b[:, None, :]).reshape(len(whole), -1)
                    cols.append(np.where(both < 0, -1, both))
        change = np.concatenate(cols, axis=1)
        rows, at = np.nonzero(change >= 0)
        return rows, whole[rows] ^ change[rows, at]

    def fingerprint_keys(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, key) of 64-bit fingerprints: two that differ in at most four bits share a key."""
        words = [(fps >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in _SEGMENTS]
        return self.keys(words, [width for _, width in _SEGMENTS], 2)


# ---- links


def forest(fps: np.ndarray, bits: int = MAX_BITS) -> tuple[list[int], list[int]]:
    """Edges that join all members of each linked set, one fewer than members: what is reached is not compared again."""
    left, a, b = fps, [], []
    while left.size:
        stack, left = [left[0]], left[1:]
        while stack and left.size:
            x = stack.pop()
            near = np.bitwise_count(left ^ x) <= bits
            if near.any():
                found, left = left[near], left[~near]
                a += [x] * found.size
                b += found.tolist()
                stack += list(found)
    return a, b


def _link_groups(bits: int):
    """Over rows sorted by bucket: the links within each bucket; a bucket may go on in the next batch."""

    def links(keys: np.ndarray, fps: np.ndarray):
        cuts = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
        starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(fps)]))
        sizes = ends - starts
        a, b = [], []
        pairs = starts[sizes == 2]
        hit = pairs[np.bitwise_count(fps[pairs] ^ fps[pairs + 1]) <= bits]
        a.append(fps[hit])
        b.append(fps[hit + 1])
        for s, e in zip(starts[sizes > 2], ends[sizes > 2]):
            x, y = forest(fps[s:e], bits)
            if x:
                a.append(np.array(x, dtype=np.uint64))
                b.append(np.array(y, dtype=np.uint64))
        a, b = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def run(batches):
        keys, fps = np.zeros((0, 2), np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            new = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)], axis=1)
            keys, fps = np.concatenate((keys, new)), np.concatenate((fps, batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)))
            if len(fps) and len(changes := np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1))):
                end = changes[-1] + 1
                yield links(keys[:end], fps[:end])
                keys, fps = keys[end:], fps[end:]
        if len(fps):
            yield links(keys, fps)

    return run


def dealt_by_key(nodes: DataFrame, keyed_of, folder: str, block: int, sample: int = SAMPLE) -> DataFrame:
    """keyed_of(nodes): (key, ...) with its rows dealt out and sorted by key and part, so that rows of a key lie together.

    Keys with more than about `block` members are dealt into blocks by a hash of the row, and every pair of blocks is a part
    of its own, so no task holds much more than two blocks of a key, and any two members meet in some part. Which keys these
    are is estimated from a `sample`th of the nodes; that decides where rows go, never which rows are compared.
    """
    node = nodes.columns[0]
    some = nodes.where(F.pmod(F.xxhash64(F.lit("sample"), node), F.lit(sample)) == 0)
    counted = keyed_of(some).groupBy("key").agg((F.count("*") * sample).alias("n")).where(F.col("n") > block)
    hot = saved(counted.select("key", F.ceil(F.col("n") / (block / 2)).cast("int").alias("blocks")), folder, "hot")
    keyed = keyed_of(nodes)
    others = [c for c in keyed.columns if c != "key"]
    rest = keyed.select("key", F.lit(0).cast("long").alias("part"), *others)
    if not hot.isEmpty():
        own = F.pmod(F.xxhash64(*others), F.col("blocks")).cast("int")
        parts = F.expr("transform(sequence(0, blocks - 1), x -> cast(least(x, own) as long) * blocks + greatest(x, own))")
        one = F.array(F.lit(0).cast("long"))
        rest = keyed.join(hot, "key", "left").withColumn("own", own).select("key", F.explode(F.when(F.col("blocks").isNull(), one).otherwise(parts)).alias("part"), *others)
    return rest.repartition("key", "part").sortWithinPartitions("key", "part")


def links(nodes: DataFrame, folder: str, bits: int = MAX_BITS, block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """Distinct (fp) -> (a, b): edges between fingerprints within `bits` bits that span every linked set (all that
    components need), never all pairs."""
    large_batches(nodes.sparkSession)

    def run(batches):
        code = Golay()
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k in range(0, len(fps), 4096):
                rows, keys = code.fingerprint_keys(fps[k : k + 4096])
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[k : k + 4096][rows].view(np.int64))], names=["key", "fp"])

    dealt = dealt_by_key(nodes.select("fp"), lambda n: n.mapInArrow(run, "key long, fp long"), folder, block, sample)
    return dealt.mapInArrow(_link_groups(bits), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED, bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs: component_id is the smallest id reached over links of at most
    `bits` (4 or fewer) differing bits.

    Null or wordless texts have fingerprint 0 and link like any other. Repeated ids give repeated rows. A null id is kept
    and takes the component of its fingerprint (null if no id is there). An empty table gives an empty one. Other columns
    of docs are not read, so their names may clash with anything.
    """
    if not 0 <= bits <= MAX_BITS:
        raise ValueError("the keys find links of at most four bits")
    folder = shared_dir(docs.sparkSession)
    fps = saved(fingerprints(docs, id_col, text_col, shingle, seed), folder, "fingerprints")
    nodes = saved(fps.groupBy("fp").agg(F.min("doc_id").alias("head")), folder, "nodes")
    labels = components(links(nodes, folder, bits), folder)
    joined = nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    heads = joined.groupBy("label").agg(F.min("head").alias("component_id"))
    classes = saved(joined.join(heads, "label").select("fp", "component_id"), folder, "classes")
    discard(docs.sparkSession, f"{folder}/nodes")
    return fps.join(classes, "fp").select("doc_id", "fp", "component_id")


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for all documents."""
    from .common import documents

    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
