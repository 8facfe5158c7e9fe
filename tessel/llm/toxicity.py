"""Toxicity by a classifier chain: each category's linear model sees the probabilities of the categories before it.

The models learn from a bounded sample of labelled documents. The probabilities that a later model is trained on are out of
fold: each sampled document's come from a model that did not see it, whose words were chosen without its labels too. Fits run
as Spark tasks, one for each fold; scoring runs over whole texts of all documents.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, sampled, small_batches

#: Labelled documents that are learned from, about. Of their words those are features that occur in so many of them at least
#: and go with some category more than chance has it (chi-square); on sf0.1 models of all words, with any penalty, find less
#: than half of the toxic documents and these 0.83. There is no cap on their number.
TRAIN_DOCS, MIN_DOCS, MIN_CHI2 = 8_000, 5, 20.0
FOLDS, STEPS, RATE, PENALTY = 3, 120, 0.15, 1e-4
THRESHOLD = 0.5
#: Categories in the order of the chain, as 0/1 columns of the labels table (null: not labelled).
CATEGORIES = {"low_quality": "1 - quality", "toxic": "toxic"}
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


class Linear:
    """A logistic regression on word presence and the probabilities of earlier categories."""

    def __init__(self, weights: np.ndarray, extra: np.ndarray, bias: float) -> None:
        self.weights, self.extra, self.bias = weights, extra, bias

    @classmethod
    def fit(cls, rows: np.ndarray, cols: np.ndarray, n_features: int, earlier: np.ndarray, y: np.ndarray) -> "Linear":
        """rows, cols: the words that each document has. Full-batch Adam from zero, so refits agree."""
        n, k = len(y), earlier.shape[1]
        w, m, v = np.zeros(n_features + k + 1), 0.0, 0.0
        positive = max(y.mean(), 1e-9)
        w[-1] = np.log(positive / max(1 - positive, 1e-9)) if 0 < y.mean() < 1 else (-20.0 if y.mean() == 0 else 20.0)
        for t in range(1, STEPS + 1):
            z = np.bincount(rows, w[cols], minlength=n) + earlier @ w[n_features:-1] + w[-1]
            e = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
            g = np.concatenate((np.bincount(cols, e[rows], minlength=n_features), e @ earlier, [e.sum()])) / n
            g[:-1] += PENALTY * w[:-1]
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        return cls(w[:n_features], w[n_features:-1], float(w[-1]))

    def probability(self, rows: np.ndarray, cols: np.ndarray, n: int, earlier: np.ndarray) -> np.ndarray:
        z = np.bincount(rows, self.weights[cols], minlength=n) + earlier @ self.extra + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Chain:
    def __init__(self, vocabulary: dict[str, int], categories: list[str], models: list[Linear]) -> None:
        self.vocabulary, self.categories, self.models = vocabulary, categories, models

    def features(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        own = [[self.vocabulary[w] for w in words_of(t) if w in self.vocabulary] for t in texts]
        return np.repeat(np.arange(len(texts)), [len(x) for x in own]), np.array([c for x in own for c in sorted(x)], dtype=np.int64)

    def predict(self, texts: list[str | None]) -> np.ndarray:
        """One column of probabilities for each category."""
        rows, cols = self.features(texts)
        found = np.zeros((len(texts), 0))
        for model in self.models:
            found = np.column_stack((found, model.probability(rows, cols, len(texts), found)))
        return found


def _fit_folds(spark, data, earlier: np.ndarray, y: np.ndarray, n_features: int) -> list[Linear]:
    """Models without each fold in turn, then one on all; each is fitted by a task of its own, on the words chosen for it."""
    shared = spark.sparkContext.broadcast((earlier, y))

    def run(batches):
        rows, cols, fold, chosen = data.value
        earlier, y = shared.value
        for b in batches:
            for k in b["id"]:
                keep = fold != k
                at = np.cumsum(keep) - 1
                seen = keep[rows] & chosen[k][cols]
                m = Linear.fit(at[rows[seen]], cols[seen], n_features, earlier[keep], y[keep])
                yield pd.DataFrame({"fold": [k], "w": [np.concatenate((m.weights, m.extra, [m.bias])).tolist()]})

    found = spark.range(0, FOLDS + 1, 1, FOLDS + 1).mapInPandas(run, "fold long, w array<double>").collect()
    return [Linear(np.array(r.w[:n_features]), np.array(r.w[n_features:-1]), r.w[-1]) for r in sorted(found, key=lambda r: r.fold)]


def fold_of(id_col: str) -> Column:
    return F.pmod(F.xxhash64(F.lit("fold"), id_col), F.lit(FOLDS)).cast("int")


def _goes_with_a_category(folds: dict, ys: list[str], used: list[int]) -> Column:
    """Whether a word of `counts` occurs often enough in the folds used and goes with a category there (chi-square)."""
    own = [folds[k] for k in used if k in folds]
    n, here = sum(f["n"] for f in own), sum((F.col(f"n{k}") for k in used), F.lit(0))
    means = {y: sum(f[y] for f in own) / n for y in ys} if n else {}
    chi2 = [F.pow(sum((F.col(f"{y}_{k}") for k in used), F.lit(0.0)) - here * p, 2) / (here * p * (1 - p)) * n / (n - here + 1) for y, p in means.items() if 0 < p < 1]
    return F.coalesce((here >= MIN_DOCS) & (F.greatest(*chi2, F.lit(0.0), F.lit(0.0)) >= MIN_CHI2), F.lit(False))


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, str] = CATEGORIES, id_col: str = "doc_id", text_col: str = "text", max_docs: int = TRAIN_DOCS) -> Chain:
    """categories: name -> SQL expression over labels. Labels or texts that are null teach nothing.

    At most about max_docs labelled documents are used, chosen by a hash of their id, so that the sample and what is
    broadcast stay bounded at any size. An id with several labels has a category if one of them says so; of documents that share
    an id the smallest text is learned from; rows without an id teach nothing. Other columns are not read. Without labelled documents the chain gives 0 for everything.
    """
    spark = docs.sparkSession
    marks = labels.select(F.col(id_col).cast("long").alias("id"), *[F.expr(e).cast("double").alias(f"y{k}") for k, e in enumerate(categories.values())]).dropna()
    n = marks.count()
    marks = sampled(marks, n, max_docs, "sample", "id").groupBy("id").agg(*[F.max(f"y{k}").alias(f"y{k}") for k in range(len(categories))])
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).dropna()
    small_batches(spark)

    def bags(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array([sorted(words_of(t)) for t in b.column(0).to_pylist()], pa.list_(pa.string()))], names=[*b.schema.names[1:], "words"])

    ys = [f"y{k}" for k in range(len(categories))]
    # the sample of marks is bounded by max_docs, and so is that of texts: one for each id
    drawn = texts.join(F.broadcast(marks), "id").groupBy("id", *ys).agg(F.min("text").alias("text"))
    sample = drawn.select("text", "id", fold_of("id").alias("fold"), *ys).mapInArrow(bags, "id long, fold int, " + ", ".join(f"{y} double" for y in ys) + ", words array<string>").cache()
    folds = {r["fold"]: r for r in sample.groupBy("fold").agg(F.count("*").alias("n"), *[F.sum(y).alias(y) for y in ys]).collect()}
    each = [F.count_if(F.col("fold") == k).alias(f"n{k}") for k in range(FOLDS)] + [F.sum(F.when(F.col("fold") == k, F.col(y)).otherwise(0.0)).alias(f"{y}_{k}") for y in ys for k in range(FOLDS)]
    counts = sample.select(F.explode("words").alias("w"), "fold", *ys).groupBy("w").agg(*each)
    takes = [_goes_with_a_category(folds, ys, [k for k in range(FOLDS) if k != out]) for out in range(FOLDS + 1)]
    found = counts.select("w", *[t.alias(f"t{k}") for k, t in enumerate(takes)]).where(" or ".join(f"t{k}" for k in range(FOLDS + 1))).collect()
    found.sort(key=lambda r: r["w"])
    vocabulary = {r["w"]: k for k, r in enumerate(found)}
    chosen = np.array([r[1:] for r in found], dtype=bool).reshape(-1, FOLDS + 1).T
    known = spark.sparkContext.broadcast(vocabulary)

    def numbers(batches):
        for b in batches:
            v = known.value
            own = [sorted(v[w] for w in x if w in v) for x in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(own, pa.list_(pa.int32()))], names=[*b.schema.names[:-1], "own"])

    found = sample.mapInArrow(numbers, "id long, fold int, " + ", ".join(f"{y} double" for y in ys) + ", own array<int>").toPandas().sort_values("id", ignore_index=True)
    sample.unpersist()
    names = list(categories)
    if not len(found):
        return Chain({}, names, [Linear(np.zeros(0), np.zeros(k), -30.0) for k in range(len(names))])
    rows, cols = np.repeat(np.arange(len(found)), found["own"].map(len)), np.concatenate(found["own"].to_list()).astype(np.int64)
    fold = found["fold"].to_numpy()
    data = spark.sparkContext.broadcast((rows, cols, fold, chosen))
    earlier, models = np.zeros((len(found), 0)), []
    for y in ys:
        *out_of_fold, whole = _fit_folds(spark, data, earlier, found[y].to_numpy(), len(vocabulary))
        p = np.stack([m.probability(rows, cols, len(found), earlier) for m in out_of_fold])
        earlier = np.column_stack((earlier, p[fold, np.arange(len(found))]))
        models.append(whole)
    return Chain(vocabulary, names, models)


def score(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """Adds p_<category> (0 to 1) for each category of the chain to every row of docs, in place of columns of these names.

    A null or empty text has no words: its probabilities are the models' base rates. Repeated rows are scored each; an
    empty table gives an empty one.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(chain)
    names = [f"p_{c}" for c in chain.categories]
    docs = docs.drop(*names)
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            p = shared.value.predict(b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(p[:, k]) for k in range(p.shape[1]))], names=[*b.schema.names, *names])

    return docs.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), *(f"{n} double" for n in names)]))


def flagged(p: Column, threshold: float = THRESHOLD) -> Column:
    return p >= threshold


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    """doc_id, the chain's probabilities, and whether the document is toxic, for all documents."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    chain = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, chain).select("doc_id", "p_low_quality", "p_toxic", flagged(F.col("p_toxic")).alias("toxic"))
