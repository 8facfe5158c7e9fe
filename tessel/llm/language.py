"""Language ID: known words score by their log frequency in each language, others by ever shorter character n-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, draw, small_batches

#: Labelled documents that the model learns from, about, in equal shares for each language: all of a language that has no
#: more than its share, else that many by a hash, so that a rare language is learned beside frequent ones. Of their words the
#: most frequent of each language are known to the model, so many at most; both bound what is broadcast.
TRAIN_DOCS, MAX_WORDS = 20_000, 200_000
#: Longest n-gram, and the weight that smooths counts.
LONGEST, SMOOTHING = 5, 0.5
#: Scored words that a worker remembers.
MEMO = 200_000
UNKNOWN = "und"
_LETTERS = regex.compile(r"\p{L}+")


def _hashes(names: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(n) for n in names), np.uint64, len(names))


class Table:
    """Log frequencies of names, a row for each and a column for each language, found by 64-bit hashes of the names: some
    forty bytes a name, as every worker holds them all."""

    def __init__(self, counts: list[dict[str, int]]) -> None:
        names = list(set().union(*counts))
        keys = _hashes(names)
        order = np.argsort(keys)
        self.keys, place = keys[order], dict(zip(names, np.argsort(order).tolist()))
        self.counts = np.zeros((len(names), len(counts)))
        for j, own in enumerate(counts):
            self.counts[[place[n] for n in own], j] = np.fromiter(own.values(), float, len(own))
        self.logs = self.counts + SMOOTHING
        if len(names):
            self.logs = np.log(self.logs / self.logs.sum(axis=0, keepdims=True))

    def find(self, names: list[str]) -> np.ndarray:
        """The row of each name, -1 for those that are not there."""
        if not len(self.keys):
            return np.full(len(names), -1)
        wanted = _hashes(names)
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, at, -1)


class Model:
    """Log frequencies of words and of n-grams of each size."""

    def __init__(self, counts: dict[str, dict[str, int]]) -> None:
        """counts: language -> word -> occurrences."""
        self.langs = sorted(counts)
        self.words = Table([counts[k] for k in self.langs])
        #: Words of each language that occur twice or more.
        self.known = self.words.counts > 1
        self.words.counts, self.grams = None, {}
        for size in range(LONGEST, 0, -1):
            own = []
            for k in self.langs:
                sums: dict[str, int] = {}
                for word, c in counts[k].items():
                    for g in self.grams_of(word, size):
                        sums[g] = sums.get(g, 0) + c
                own.append(sums)
            self.grams[size] = Table(own)
            self.grams[size].counts = None

    @staticmethod
    def grams_of(word: str, size: int) -> list[str]:
        if size == 1:  # the ends alone say nothing
            return list(word)
        padded = f"^{word}$"
        return [padded[k : k + size] for k in range(len(padded) - size + 1)]

    def score(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(scores, known) of words, a column for each language: a word's log frequencies if it is known in any language, else
        the mean over its n-grams of the longest size of which any is known, else zeros."""
        n = len(self.langs)
        scores, known = np.zeros((len(words), n)), np.zeros((len(words), n), dtype=bool)
        row = self.words.find(words)
        there = row >= 0
        scores[there], known[there] = self.words.logs[row[there]], self.known[row[there]]
        left = np.flatnonzero(~there)
        for size in range(LONGEST, 0, -1):
            if not left.size:
                break
            parts = [self.grams_of(words[k], size) for k in left.tolist()]
            own = np.repeat(np.arange(left.size), [len(p) for p in parts])
            row = self.grams[size].find([g for p in parts for g in p])
            own, row = own[row >= 0], row[row >= 0]
            times = np.bincount(own, minlength=left.size)
            for j in range(n):
                sums = np.bincount(own, self.grams[size].logs[row, j], minlength=left.size)
                scores[left, j] = np.where(times > 0, sums / np.maximum(times, 1), 0.0)
            left = left[times == 0]
        return scores, known


class Scorer:
    """Scores texts; remembers a bounded number of words."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.memo: dict[str, int] = {}
        self.table = np.zeros((1024, len(self.model.langs)))
        self.known = np.zeros((1024, len(self.model.langs)), dtype=bool)

    def learn(self, words: list[str]) -> None:
        """Scores of words that are not remembered yet, all at once."""
        scores, known = self.model.score(words)
        n = len(self.memo)
        while n + len(words) > len(self.table):
            self.table = np.concatenate((self.table, np.zeros_like(self.table)))
            self.known = np.concatenate((self.known, np.zeros_like(self.known)))
        self.table[n : n + len(words)], self.known[n : n + len(words)] = scores, known
        self.memo.update(zip(words, range(n, n + len(words))))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """Of each text the language, its probability, and the share of the words that it knows, with one more counted as
        known: one to three new words are no evidence."""
        split = [_LETTERS.findall(t.lower()) if t else [] for t in texts]
        if not self.model.langs:
            return [(UNKNOWN, 0.0, 0.0)] * len(texts)
        if len(self.memo) > MEMO:
            self.clear()
        self.learn(list(set().union(*map(set, split)).difference(self.memo)))
        out = []
        for words in split:
            if not words:
                out.append((UNKNOWN, 0.0, 0.0))
                continue
            at = np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))
            total = self.table[at].sum(axis=0)
            p = np.exp(total - total.max())
            best = int(np.argmax(p))
            out.append((self.model.langs[best], float(p[best] / p.sum()), float((self.known[at, best].sum() + 1) / (len(at) + 1))))
        return out


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", max_docs: int = TRAIN_DOCS, max_words: int = MAX_WORDS) -> Model:
    """Word counts of each language over the labelled rows of docs, at most about max_docs of them (by a hash of id and text),
    in equal shares for each language, and of its max_words most frequent words (ties by the word).

    Rows with a null text or language teach nothing; without any labelled row the model knows no language. Repeated rows
    teach as often as they occur.
    """
    labelled = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).dropna(subset=["text", "lang"])
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # a row for each language
    if not sizes:
        return Model({})
    share = max(max_docs // len(sizes), 1)
    rates = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, share / n))])
    drawn = labelled.where(draw("train", "id", "text") < F.element_at(rates, F.col("lang")))
    word = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), "word"))
    words = drawn.select("lang", word).groupBy("lang", "word").count().withColumn("place", place).where(F.col("place") <= max_words)
    counts: dict[str, dict[str, int]] = {lang: {} for lang in sizes}
    for r in words.select("lang", "word", "count").toLocalIterator():
        counts[r["lang"]][r["word"]] = r["count"]
    return Model(counts)


def identify(docs: DataFrame, model: Model, text_col: str = "text", known_col: str | None = None) -> DataFrame:
    """Adds lang_pred and score (0 to 1) to every row of docs, in place of columns of these names, and on demand known_col:
    the share of the words that the model has seen twice or more in lang_pred (one more counted as known in each text), which
    does not follow the text's length.

    lang_pred is `und`, with score 0, for a null text or one without letters, and where the model knows no language.
    Ties go to the first language in order. Whole texts are scored; repeated rows each; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "score", *([known_col] if known_col else []))
    at = docs.columns.index(text_col)

    def run(batches):
        scorer = Scorer(shared.value)
        for b in batches:
            found = scorer.predict(b.column(at).to_pylist())
            cols = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            names = [*b.schema.names, "lang_pred", "score"]
            if known_col:
                cols.append(pa.array([f[2] for f in found], pa.float64()))
                names.append(known_col)
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=names)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "lang_pred string, score double", *([f"`{known_col}` double"] if known_col else [])])
    return docs.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> F.Column:
    """True for the fifth of the documents that nothing is learned from; ids that are null are not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def op10_language(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs.where(~held_out()))
    found = identify(docs.select("doc_id", "text", held_out().alias("held_out")), model)
    return found.select("doc_id", "held_out", "lang_pred", "score")
