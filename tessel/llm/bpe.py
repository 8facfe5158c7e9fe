"""BPE encoding and decoding with a lexicon of frequent words: a minimal acyclic transducer, memory-mapped by the workers.

Spark counts the words of the whole corpus; the most frequent are merged once and compiled on the driver into a minimal
acyclic automaton (suffixes shared). Every arc carries the number of words that sort before what it leads to, so the sum
over a path numbers the word, and the number points to its token ids. Workers map the file and look all distinct words of
a batch up together, arc by arc; words that are not there are merged exactly.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
import mmap
import os
import tempfile

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, saved, shared_dir, small_batches

#: Words of the lexicon at most; with at most MAX_WORD bytes each this bounds what is broadcast.
LEXICON, MAX_WORD = 65_536, 48
#: Occurrences from which on a word may go into the lexicon.
LEAST = 8
#: Words whose ids a worker remembers; beyond that it starts anew.
MEMO = 250_000
#: Fixed value: how the format splits text into words before merging (runs of letters first, as they are the most frequent;
#: no other alternative can begin where they do).
PATTERN = r""" ?\p{L}++|'(?:[stmd]|re|ve|ll)| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s+(?!\S)|\s+"""
#: Letters with at most one space before: what the lexicon holds.
LEXICON_WORD = r" ?\p{L}+"
#: Above all ranks.
NONE = 1 << 30


def byte_symbols() -> list[str]:
    """The printable character by which the vocabulary file writes each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in plain}
    out |= {b: chr(0x100 + k) for k, b in enumerate(x for x in range(256) if x not in out)}
    return [out[b] for b in range(256)]


class Vocabulary:
    """A byte-level BPE vocabulary file: merges by rank, bytes of the ids, special tokens."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbols = byte_symbols()
        to_byte = {s: b for b, s in enumerate(symbols)}
        vocab = spec["model"]["vocab"]
        self.byte_ids = [vocab[s] for s in symbols]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        #: first id << 20 | second id -> rank, and the id that a rank gives
        self.ranks = {vocab[a] << 20 | vocab[b]: rank for rank, (a, b) in reversed(list(enumerate(pairs)))}
        self.merged = [vocab[a + b] for a, b in pairs]
        self.byte_ranks = [[self.ranks.get(a << 20 | b, NONE) for b in self.byte_ids] for a in self.byte_ids]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.token_bytes = [b""] * size
        for token, k in vocab.items():
            self.token_bytes[k] = bytes(to_byte[c] for c in token) if all(c in to_byte for c in token) else token.encode()
        for token, k in self.special.items():
            self.token_bytes[k] = token.encode()
        self.words = regex.compile(PATTERN)
        self.splits = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word: the pair of lowest rank, leftmost first, is merged until there is none."""
        return self._merge_short(word) if len(word) <= 48 else self._merge_long(word)

    def _merge_short(self, word: bytes) -> list[int]:
        rank, merged, rows, own = self.ranks.get, self.merged, self.byte_ranks, self.byte_ids
        ids = [own[b] for b in word]
        found = [rows[a][b] for a, b in zip(word, word[1:])]
        while found and (best := min(found)) != NONE:
            k = found.index(best)
            ids[k : k + 2] = [merged[best]]
            del found[k]
            if k < len(found):
                found[k] = rank(ids[k] << 20 | ids[k + 1], NONE)
            if k:
                found[k - 1] = rank(ids[k - 1] << 20 | ids[k], NONE)
        return ids

    def _merge_long(self, word: bytes) -> list[int]:
        """The same with a heap over a linked list, as a word may be as long as its document."""
        ids, n = [self.byte_ids[b] for b in word], len(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k) for k, (a, b) in enumerate(zip(word, word[1:])) if (r := self.byte_ranks[a][b]) != NONE]
        heapq.heapify(heap)
        while heap:
            rank, k = heapq.heappop(heap)
            j = after[k]
            if ids[k] is None or j >= n or self.ranks.get(ids[k] << 20 | ids[j]) != rank:
                continue
            ids[k], ids[j] = self.merged[rank], None
            after[k] = after[j]
            if after[k] < n:
                before[after[k]] = k
            for i in (before[k], k):
                if i >= 0 and (o := after[i]) < n and (r := self.ranks.get(ids[i] << 20 | ids[o])) is not None:
                    heapq.heappush(heap, (r, i))
        return [x for x in ids if x is not None]


# ---- the lexicon


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """Sorted words are added one by one; what no later word can change is replaced by an equal state if there is one."""
    words = sorted(w for w in entries if w)
    arcs: list[dict[int, int]] = [{}]
    final: list[bool] = [False]
    register: dict[tuple, int] = {}
    path = [0]

    def settle(depth: int) -> None:
        while len(path) - 1 > depth:
            state = path.pop()
            same = register.setdefault((final[state], *arcs[state].items()), state)
            arcs[path[-1]][last[len(path) - 1]] = same

    last = b""
    for word in words:
        common = len(os.path.commonprefix([word, last]))
        settle(common)
        for byte in word[common:]:
            arcs.append({})
            final.append(False)
            arcs[path[-1]][byte] = len(arcs) - 1
            path.append(len(arcs) - 1)
        final[path[-1]] = True
        last = word
    settle(0)
    order, number = [0], {0: 0}
    for state in order:
        for to in arcs[state].values():
            if to not in number:
                number[to] = len(order)
                order.append(to)
    below: dict[int, int] = {}

    def count(top: int) -> None:
        stack = [top]
        while stack:
            state = stack[-1]
            todo = [t for t in arcs[state].values() if t not in below]
            if todo:
                stack += todo
            else:
                below[state] = final[state] + sum(below[t] for t in arcs[state].values())
                stack.pop()

    count(0)
    keys, targets, skips = [], [], []
    for state in order:
        seen = int(final[state])
        for byte, to in sorted(arcs[state].items()):
            keys.append(number[state] << 8 | byte)
            targets.append(number[to])
            skips.append(seen)
            seen += below[to]
    ids = [entries[w] for w in words]
    parts = [
        np.array(keys, np.int32), np.array(targets, np.int32), np.array(skips, np.int32), np.array([final[s] for s in order], np.int32),
        np.cumsum([0, *map(len, ids)]).astype(np.int32), np.array(list(itertools.chain.from_iterable(ids)), np.int32),
    ]
    return np.array([len(p) for p in parts], np.int32).tobytes() + b"".join(p.tobytes() for p in parts)


class Lexicon:
    """The compiled automaton, mapped from a file that goes with the process."""

    def __init__(self, compiled: bytes) -> None:
        with tempfile.TemporaryFile() as f:
            f.write(compiled)
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        sizes = np.frombuffer(self.map, np.int32, 6)
        at, parts = 24, []
        for n in sizes.tolist():
            parts.append(np.frombuffer(self.map, np.int32, n, at))
            at += 4 * n
        self.keys, self.targets, self.skips, self.final, self.starts, self.ids = parts

    def find(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 where it is not in the lexicon."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(sizes) - sizes
        number, state = np.zeros(len(words), np.int64), np.zeros(len(words), np.int32)
        out = np.full(len(words), -1, np.int64)
        live = np.flatnonzero((sizes > 0) & (sizes <= MAX_WORD)) if len(self.keys) else np.zeros(0, np.int64)
        step = 0
        while live.size:
            key = state[live] << 8 | flat[begin[live] + step]
            k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[k] == key
            live, k = live[ok], k[ok]
            number[live] += self.skips[k]
            state[live] = self.targets[k]
            step += 1
            done = sizes[live] == step
            ended = live[done]
            out[ended] = np.where(self.final[state[ended]] == 1, number[ended], -1)
            live = live[~done]
        return out

    def ids_of(self, number: int) -> list[int]:
        return self.ids[self.starts[number] : self.starts[number + 1]].tolist()


class Codec:
    """Encodes and decodes with a vocabulary and a lexicon; remembers a bounded number of words."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None = None) -> None:
        self.vocabulary, self.lexicon, self.memo = vocabulary, lexicon, {}

    def learn(self, words: set[str]) -> None:
        """Ids of words that are not remembered yet: from the lexicon, the rest by merging."""
        v = self.vocabulary
        new = [w for w in words if w not in v.special]
        raw = [w.encode() for w in new]
        found = self.lexicon.find(raw).tolist() if self.lexicon else [-1] * len(new)
        for word, r, number in zip(new, raw, found):
            self.memo[word] = tuple(self.lexicon.ids_of(number) if number >= 0 else v.merge(r))
        self.memo.update((w, (v.special[w],)) for w in words if w in v.special)

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text. New words of all texts are looked up together, in one walk over the lexicon."""
        v = self.vocabulary
        split = [v.splits.split(t) if v.splits is not None and any(s in t for s in v.special) else [t] for t in texts]
        words = [[[p] if p in v.special else v.words.findall(p) for p in pieces] for pieces in split]
        flat = [w for pieces in words for own in pieces for w in own]
        if len(self.memo) > MEMO:
            self.memo.clear()
        self.learn(set(flat).difference(self.memo))
        memo = self.memo
        return [list(itertools.chain.from_iterable(memo[w] for own in pieces for w in own)) for pieces in words]

    def decode(self, ids) -> str:
        return b"".join(map(self.vocabulary.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


# ---- on Spark


def frequent_words(docs: DataFrame, text_col: str = "text", size: int = LEXICON) -> DataFrame:
    """(word, n): at most `size` words, those of the most occurrences over all documents.

    All words of some count or none are taken, so that no task or driver has to order more than it returns: the lowest
    count comes from a table of counts in classes of an eighth of a power of two.
    """
    words = docs.select(F.explode(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(LEXICON_WORD), F.lit(0))).alias("word"))
    counted = words.where(F.octet_length("word") <= MAX_WORD).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST)
    counted = saved(counted.withColumn("class", F.floor(F.log2("n") * 8).cast("int")), shared_dir(docs.sparkSession), "words")
    least, left = None, size
    for r in sorted(counted.groupBy("class").count().collect(), key=lambda r: -r["class"]):
        left -= r["count"]
        if left < 0:
            break
        least = r["class"]
    return counted.where(F.col("class") >= least if least is not None else F.lit(False)).select("word", "n")


def build_lexicon(docs: DataFrame, path: str, text_col: str = "text", size: int = LEXICON) -> bytes:
    vocabulary = Vocabulary(path)
    entries = {w: vocabulary.merge(w) for w in (r.word.encode() for r in frequent_words(docs, text_col, size).collect())}
    return compile_lexicon(entries)


_codecs: dict[tuple[str, str], Codec] = {}


def _codec(path: str, digest: str, lexicon) -> Codec:
    """The codec of this worker process, which goes from task to task."""
    if (path, digest) not in _codecs:
        _codecs.clear()
        _codecs[path, digest] = Codec(Vocabulary(path), Lexicon(lexicon.value))
    return _codecs[path, digest]


def encode_documents(docs: DataFrame, path: str, text_col: str = "text", size: int = LEXICON) -> DataFrame:
    """Adds ids (array of int) to every row of docs, in place of a column of that name.

    The vocabulary file at `path` must be on every executor. Null or empty texts have no ids. Special tokens in a text
    get their own id, none is added. Repeated rows are encoded each; an empty table gives an empty one.
    """
    return _per_document(docs, path, text_col, size, "ids array<int>", lambda codec, texts: [pa.array(codec.encode([t or "" for t in texts]), pa.list_(pa.int32()))])


def decode_documents(docs: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """Adds decoded (string) to every row of docs; null ids count as none. Bytes that are not UTF-8 become U+FFFD."""
    return _per_document(docs, path, ids_col, 0, "decoded string", lambda codec, ids: [pa.array([codec.decode(x if x is not None else ()) for x in ids], pa.string())])


def round_trip(docs: DataFrame, path: str, text_col: str = "text", size: int = LEXICON) -> DataFrame:
    """Adds n_tokens, ids_sha256 (of the decimal ids joined by commas) and decoded_sha256 to every row of docs, in place of
    columns of these names.

    Encodes and decodes within one pass, so that ids need not be kept. A null or empty text has no tokens: its digests are
    those of the empty text. Texts of any length are encoded whole; null ids and repeated rows are kept; an empty table gives
    an empty one."""

    def run(codec, texts):
        n, ids_hash, text_hash = [], [], []
        names = codec.names = getattr(codec, "names", None) or [str(k) for k in range(len(codec.vocabulary.token_bytes))]
        for ids in codec.encode([t or "" for t in texts]):
            n.append(len(ids))
            ids_hash.append(hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest())
            text_hash.append(hashlib.sha256(codec.decode(ids).encode()).hexdigest())
        return [pa.array(n, pa.int64()), pa.array(ids_hash), pa.array(text_hash)]

    return _per_document(docs, path, text_col, size, "n_tokens long, ids_sha256 string, decoded_sha256 string", run)


def _per_document(docs: DataFrame, path: str, col: str, size: int, added: str, work) -> DataFrame:
    spark = docs.sparkSession
    names = [x.split()[0] for x in added.split(", ")]
    compiled = build_lexicon(docs, path, col, size) if size else compile_lexicon({})
    digest, lexicon = hashlib.sha256(compiled).hexdigest(), spark.sparkContext.broadcast(compiled)
    small_batches(spark)
    docs = docs.drop(*(n for n in names if n != col))
    at = docs.columns.index(col)

    def run(batches):
        codec = _codec(path, digest, lexicon)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, *work(codec, b.column(at).to_pylist())], names=[*b.schema.names, *names])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), added])
    return docs.mapInArrow(run, schema)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_bpe(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return round_trip(docs, vocabulary_path()).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
