"""Near copies by similarity: SimHash candidates over the Golay code, each link verified on the word shingles.

Documents that share 0.8 of their shingles differ in about an eighth of the bits of their fingerprints, far more than 64 bits
and four errors can tell from chance. So the fingerprint here is WORDS words wide and cut into PAIRS pairs of 23-bit segments.
A document emits, for each pair, the codeword indices of every word within one bit of it (about ten keys); two documents
of similarity 0.8 share a key with a probability of about 0.99, of 0.84 with 0.998, more similar ones nearly always (README).
Members of a key that differ in more than SKETCH_BITS of the first 95 bits meet there by chance and are not looked at again.
What is left forms groups. Groups that have the same first member, or whose first members have a group in common, are united, so a cluster of
near copies that meets under thousands of keys is a few groups of it. In a group not all pairs are compared: first each member with the first
of all its groups; where that leaves several components, each member with its nearest one of another component; what is then still apart is compared as far as all bits of
the fingerprints leave it possible.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import large_batches, saved, shared_dir, small_batches
from .graph import components
from .simhash import BLOCK as KEY_BLOCK
from .simhash import SAMPLE, SEED, Golay, dealt_by_key, majority, shingle_hashes

SHINGLE, SIMILARITY = 5, 0.8
#: Pairs of segments of 23 bits, and the words that hold their bits.
PAIRS = 20
WORDS = -(-2 * 23 * PAIRS // 64)
#: Bits in which the first 95 of similar documents may differ: at similarity 0.8 about 14, give or take 3.5; of unrelated
#: ones 48, give or take five.
SKETCH_BITS = 29
#: Rows of one key that one task joins; more are dealt out.
BLOCK = 256
#: Bits in which the whole fingerprints of similar documents may differ: at similarity 0.8 about 142, give or take 11.
PRINT_BITS = 188
#: Members of a group that is united with others by its first one; members of a united group, and of a part of it. A member has at most
#: some 200 keys, so no more groups meet under it.
UNITED, LARGE, PART = 64, 8192, 768
#: Rounds in which each member is compared with the nearest one of another component only. The last round after them takes all
#: that are left apart, so nothing but the number of comparisons depends on it.
NEAREST = 1
_R = np.random.default_rng(SEED)
_MULTIPLY, _ADD = _R.integers(0, 2**63, (2, WORDS), dtype=np.uint64) * np.uint64(2) + np.uint64(1), _R.integers(0, 2**63, WORDS, dtype=np.uint64)


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The set of shingles as sorted hashes."""
    return np.unique(shingle_hashes(text, shingle, SEED))


def node(found: np.ndarray) -> int:
    """Equal sets have equal nodes; 0 for none."""
    return xxhash.xxh64_intdigest(found.tobytes(), SEED) if found.size else 0


def wide_fingerprint(found: np.ndarray) -> np.ndarray:
    """WORDS words of majority bits over mixes of the shingles' hashes; none without shingles."""
    if not found.size:
        return np.zeros(0, np.uint64)
    x = found[:, None] * _MULTIPLY[0] + _ADD
    return majority((x ^ x >> np.uint64(32)) * _MULTIPLY[1])


def pair_keys(code: Golay, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of (n, WORDS) fingerprints: for each pair of segments the keys of all words within one bit."""
    bits = np.unpackbits(prints.astype(">u8").view(np.uint8).reshape(len(prints), -1), axis=1)[:, : 46 * PAIRS]
    segments = bits.reshape(len(prints), 2 * PAIRS, 23).astype(np.int64) @ (1 << np.arange(23))
    found = [code.keys([segments[:, 2 * p], segments[:, 2 * p + 1]], [23, 23], 1) for p in range(PAIRS)]
    return np.concatenate([rows for rows, _ in found]), np.concatenate([keys | p << 24 for p, (_, keys) in enumerate(found)])


def _longs(values) -> np.ndarray:
    return np.array(values, dtype=np.uint64).view(np.int64)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))


def _over_texts(docs: DataFrame, shingle: int, make, schema: str) -> DataFrame:
    """make(shingles) -> longs, beside the id and the node of every row of (doc_id, t)."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            found = [shingles(t or b"", shingle) for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_longs([node(f) for f in found])), _lists([_longs(make(f)) for f in found])], names=["doc_id", "node", "made"])

    return docs.mapInArrow(run, schema)


def _dealt(many: DataFrame, one: DataFrame, key: str, by: str, folder: str) -> DataFrame:
    """many join one on key; a key that very many rows of `many` have is cut into parts by a hash of `by`, and its row of
    `one` repeated for each."""
    hot = many.groupBy(key).count().where(F.col("count") > BLOCK).select(key, F.ceil(F.col("count") / BLOCK).cast("int").alias("parts"))
    hot = saved(hot, folder, "hot")
    part = F.coalesce(F.pmod(F.xxhash64(by), F.col("parts")), F.lit(0)).cast("int")
    left = many.join(hot, key, "left").withColumn("part", part).drop("parts")
    right = one.join(hot, key, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return left.join(right, [key, "part"]).drop("part")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float, folder: str) -> DataFrame:
    """The pairs (a, b) whose sets have that similarity."""
    with_b = pairs.join(sets.select(F.col("node").alias("b"), F.col("made").alias("sb")), "b")
    both = _dealt(with_b, sets.select(F.col("node").alias("a"), F.col("made").alias("sa")), "a", "b", folder)
    shared = both.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("n"), (F.size("sa") + F.size("sb")).alias("sizes"))
    return shared.where(F.col("n") >= F.lit(similarity) * (F.col("sizes") - F.col("n")) - 1e-9).select("a", "b")


def _pair(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _close_groups(most: int):
    """Rows (key, part, node, first, second) sorted by key and part -> (key, node, center) by first and second as 95 bits: members of each part
    that are joined by differences of at most so many bits, if they are at least two; center is the least of them. The key made here is
    the least center that this one has in a batch, so groups that have it in common are one; of groups of more than UNITED members it is
    a hash of them all."""

    def groups(keys: np.ndarray, nodes: np.ndarray, prints: np.ndarray):
        cuts = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
        starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(nodes)]))
        pairs = starts[ends - starts == 2]
        pairs = pairs[np.bitwise_count(prints[pairs] ^ prints[pairs + 1]).sum(axis=1) <= most]
        found = [np.sort(nodes[k : k + 2]) for k in pairs.tolist()]
        for s, e in zip(starts[ends - starts > 2].tolist(), ends[ends - starts > 2].tolist()):
            left = np.arange(s, e)
            while left.size > 1:
                stack, own, left = [left[0]], [left[0]], left[1:]
                while stack and left.size:
                    near = np.bitwise_count(prints[left] ^ prints[stack.pop()]).sum(axis=1) <= most
                    stack += left[near].tolist()
                    own += left[near].tolist()
                    left = left[~near]
                if len(own) > 1:
                    found.append(nodes[np.sort(own)])
        centers = np.array([f.min() for f in found], dtype=np.int64)
        hashed = lambda f: np.uint64(xxhash.xxh64_intdigest(np.sort(f).tobytes(), SEED)).astype(np.int64)
        names = np.array([c if len(f) <= UNITED else hashed(f) for c, f in zip(centers, found)], dtype=np.int64)
        flat, sizes = np.concatenate(found) if found else np.zeros(0, np.int64), [len(f) for f in found]
        rows = np.stack((np.repeat(names, sizes), flat, np.repeat(centers, sizes)))
        if rows.size:
            known, at = np.unique(flat, return_inverse=True)
            least = known.copy()
            np.minimum.at(least, at, np.where(rows[0] == rows[2], rows[0], flat))
            to = np.where(rows[0] == rows[2], least[np.searchsorted(known, rows[2])], rows[0])
            names, at = np.unique(to, return_inverse=True)
            rows[0] = np.where(np.bincount(at)[at] <= LARGE, to, rows[0])
            rows = rows[:, np.lexsort(rows[::-1])]  # of a node in a group the least center
            rows = rows[:, np.concatenate(([True], np.any(rows[:2, 1:] != rows[:2, :-1], axis=0)))]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in rows], names=["key", "node", "center"])

    def run(batches):
        keys, nodes, prints = np.zeros((0, 2), np.int64), np.zeros(0, np.int64), np.zeros((0, 2), np.uint64)
        for batch in batches:
            cols = [batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(5)]
            keys, nodes = np.concatenate((keys, np.stack(cols[:2], axis=1))), np.concatenate((nodes, cols[2]))
            prints = np.concatenate((prints, np.stack(cols[3:], axis=1).view(np.uint64)))
            if len(nodes) and len(changes := np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1))):
                end = changes[-1] + 1
                yield groups(keys[:end], nodes[:end], prints[:end])
                keys, nodes, prints = keys[end:], nodes[end:], prints[end:]
        if len(nodes):
            yield groups(keys, nodes, prints)

    return run


def candidates(nodes: DataFrame, folder: str, block: int = KEY_BLOCK, sample: int = SAMPLE) -> DataFrame:
    """(node, made: fingerprint) -> (key, node, center): groups of nodes that may be similar, each node of one once, with the least node that it meets there."""
    large_batches(nodes.sparkSession)

    def run(batches):
        code = Golay()
        for b in batches:
            own, made = b.column(0).to_numpy(zero_copy_only=False), b.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, WORDS)
            for k in range(0, len(own), 2048):
                rows, keys = pair_keys(code, made[k : k + 2048])
                first, second = made[k : k + 2048, 0].view(np.int64), (made[k : k + 2048, 1] >> np.uint64(33)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), pa.array(own[k : k + 2048][rows]), pa.array(first[rows]), pa.array(second[rows])], names=["key", "node", "first", "second"])

    keyed_of = lambda n: n.mapInArrow(run, "key int, node long, first long, second int")
    dealt = dealt_by_key(nodes.where(F.size("made") > 0).select("node", "made"), keyed_of, folder, block, sample)
    return saved(dealt.mapInArrow(_close_groups(SKETCH_BITS), "key long, node long, center long").groupBy("key", "node").agg(F.min("center").alias("center")), folder, "groups")


def united(groups: DataFrame, folder: str) -> DataFrame:
    """Groups (key, node, center) -> distinct (key, node, side), where any two nodes that have a group in common have one again.

    A group goes as a whole to the least group that the node has whose name it bears; what meets there is cut into a grid of parts, so that
    no task holds all of it: a cell of two parts is for pairs of different sides only. Where it would have more than LARGE members groups stay as they are."""
    to = groups.groupBy("node").agg(F.min("key").alias("to")).where("to < node").select(F.col("node").alias("key"), "to")
    moved = saved(groups.join(to, "key", "left").select("key", F.coalesce("to", "key").alias("to"), "node"), folder, "moved")
    many = moved.groupBy("to").agg(F.approx_count_distinct("node").alias("n")).where(F.col("n") > PART)
    many = saved(many.select("to", F.when(F.col("n") <= LARGE, F.ceil(F.col("n") / PART).cast("int")).otherwise(0).alias("parts")), folder, "many")
    own = moved.join(many, "to", "left").select(F.when(F.col("parts") == 0, F.col("key")).otherwise(F.col("to")).alias("key"), "node", F.when(F.col("parts") > 0, F.col("parts")).otherwise(1).alias("parts")).distinct()
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    cell = lambda k: F.when(F.col("parts") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least(part, k), F.greatest(part, k)))
    return saved(own.select(F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), cell)).alias("key"), "node", part.alias("side")), folder, "united")


def _near_pairs(most: int, nearest: bool):
    """Rows (key, node, label, side, made) sorted by key -> (a, b, bits): members of a key with different labels (and sides, if it has several) whose fingerprints differ in
    at most so many bits; a is paired with the nearest of them only, or with all of larger number."""

    def pairs(keys, nodes, labels, sides, prints):
        out = []
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for s, e in zip(cuts, cuts[1:]):
            own, side, words = labels[s:e], sides[s:e], np.ascontiguousarray(prints[s:e].T)
            for k in range(0, e - s, 64):
                far = np.zeros((min(64, e - s - k), e - s), dtype=np.uint16)
                for w in words:
                    far += np.bitwise_count(w[k : k + 64, None] ^ w[None, :])
                far[own[k : k + 64, None] == own[None, :]] = most + 1
                if side.min() < side.max():
                    far[side[k : k + 64, None] == side[None, :]] = most + 1
                if nearest:
                    x, y = np.arange(len(far)), far.argmin(axis=1)
                    x, y = x[far[x, y] <= most], y[far[x, y] <= most]
                else:
                    x, y = np.nonzero((far <= most) & (nodes[s + k : s + k + len(far), None] < nodes[None, s:e]))
                out.append(np.stack((nodes[s + k + x], nodes[s + y], far[x, y].astype(np.int64))))
        found = np.unique(np.concatenate(out, axis=1), axis=1) if out else np.zeros((3, 0), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1]), pa.array(found[2])], names=["a", "b", "bits"])

    def run(batches):
        held = None
        for b in batches:
            cols = [b.column(k).to_numpy(zero_copy_only=False) for k in range(4)] + [b.column(4).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, WORDS)]
            held = cols if held is None else [np.concatenate(x) for x in zip(held, cols)]
            if len(changes := np.flatnonzero(held[0][1:] != held[0][:-1])) and len(held[0]) >= 20_000:
                end = changes[-1] + 1
                yield pairs(*(x[:end] for x in held))
                held = [x[end:] for x in held]
        if held is not None and len(held[0]):
            yield pairs(*held)

    return run


def links(keyed: DataFrame, nodes: DataFrame, sets_of, folder: str, similarity: float = SIMILARITY) -> DataFrame:
    """(node, label) of the components over groups (key, node, center): label is the same for nodes that verified links join.

    nodes has the fingerprints (node, made), sets_of(nodes) gives (node, made: shingles) for the nodes of groups. A pair is not
    looked at where its nodes are in one component already."""
    large_batches(keyed.sparkSession)
    first = saved(keyed.groupBy("node").agg(F.min("center").alias("center")), folder, "first")
    sets = saved(sets_of(first.select("node")), folder, "sets")
    members, first = united(keyed, folder), first.where("node <> center")
    pairs = saved(first.select(*_pair("node", "center")).distinct(), folder, "pairs0")
    labels = components(saved(_verified(pairs, sets, similarity, f"{folder}/verify0"), folder, "links0"), f"{folder}/components0")
    for turn in range(1, NEAREST + 2):
        nearest = turn <= NEAREST
        own = saved(members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), folder, f"labelled{turn}")
        apart = saved(own.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key"), folder, f"apart{turn}")
        if apart.isEmpty():
            return labels
        rows = own.join(apart, "key").join(nodes.select("node", "made"), "node").select("key", "node", "label", "side", "made")
        found = rows.repartition("key").sortWithinPartitions("key").mapInArrow(_near_pairs(PRINT_BITS, nearest), "a long, b long, bits long")
        if nearest:  # the nearest over all groups of a node
            found = found.groupBy("a").agg(F.min(F.struct("bits", "b")).alias("m")).select("a", "m.b")
        pairs = saved(found.select(*_pair("a", "b")).distinct(), folder, f"pairs{turn}")
        new = saved(_verified(pairs, sets, similarity, f"{folder}/verify{turn}"), folder, f"links{turn}")
        labels = saved(_joined(labels, new, f"{folder}/components{turn}"), folder, f"labels{turn}")
    return labels


def _joined(labels: DataFrame, links: DataFrame, folder: str) -> DataFrame:
    """(node, label) after more links (a, b): only the components that they join are looked at."""
    end = lambda x: labels.select(F.col("node").alias(x), F.col("label").alias(f"of_{x}"))
    ends = links.join(end("a"), "a", "left").join(end("b"), "b", "left").select("a", "b", F.coalesce("of_a", "a").alias("x"), F.coalesce("of_b", "b").alias("y"))
    new = components(saved(ends.select(F.col("x").alias("a"), F.col("y").alias("b")), folder, "joined"), folder).select(F.col("node").alias("label"), F.col("label").alias("to"))
    known = labels.unionByName(links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(labels, "node", "left_anti").withColumn("label", F.col("node")))
    return known.join(new, "label", "left").select("node", F.coalesce("to", "label").alias("label"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, node, component_id) for every row of docs: component_id is the smallest id reached over links between
    documents whose sets of word shingles have a Jaccard similarity of at least `similarity` (0.8 or more: the keys are made
    for that).

    Links are verified on 64-bit hashes of the shingles. A text of fewer words is one shingle; null and wordless texts are
    copies of each other. Rows with a null id are kept; where all rows of a text have one, it links nothing and the component
    is null. Repeated ids give repeated rows. An empty table gives an empty one. Other columns of docs are not read.
    """
    if not SIMILARITY <= similarity <= 1:
        raise ValueError("the keys find similarities of 0.8 or more")
    folder = shared_dir(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    rows = saved(_over_texts(texts, shingle, wide_fingerprint, "doc_id long, node long, made array<long>"), folder, "prints")
    nodes = saved(rows.groupBy("node").agg(F.min("doc_id").alias("head"), F.first("made").alias("made")), folder, "nodes")

    def sets_of(wanted: DataFrame) -> DataFrame:
        heads = nodes.join(wanted, "node").select(F.col("head").alias("doc_id"))
        return _over_texts(texts.join(heads, "doc_id", "left_semi"), shingle, lambda found: found, "doc_id long, node long, made array<long>").select("node", "made").dropDuplicates(["node"])

    own = nodes.where("head is not null")
    labels = links(candidates(own, folder), own, sets_of, folder, similarity)
    joined = nodes.select("node", "head").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    heads = joined.groupBy("label").agg(F.min("head").alias("component_id"))
    classes = saved(joined.join(heads, "label").select("node", "component_id"), folder, "classes")
    return rows.select("doc_id", "node").join(classes, "node").select("doc_id", "node", "component_id")
