"""A corpus pipeline over documents: language ID, line dedup, near-dedup, mixing, tokenising."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm import bpe, jaccard, language, lines, mixing
from tessel.llm.common import saved, shared_dir

#: A document is rejected if no language is found, if the best one has less than this probability, or if that language knows
#: less than this share of its words (on sf0.1, held-out documents have 0.52 to 1, random letters 0.04 or less).
MIN_SCORE, MIN_KNOWN = 0.5, 0.25
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; lang holds it from here on."""
    model = language.train(docs.where(~language.held_out()))
    found = language.identify(docs, model, known_col="known")
    kept = found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= MIN_SCORE) & (F.col("known") >= MIN_KNOWN))
    return kept.withColumn("lang", F.col("lang_pred")).select(COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that a smaller document holds too."""
    found = lines.dedup_lines(docs)
    return found.withColumn("text", F.when(F.col("n_dropped") > 0, F.col("kept")).otherwise(F.col("text"))).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of documents that share 0.8 or more of their five-word shingles: SimHash
    fingerprints find the candidates over the Golay code, as in operator 9, and each link is verified on the shingles."""
    found = jaccard.near_copies(docs)
    gone = found.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.repeated(mixing.mix_sources(docs)).select(COLUMNS)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document, with what decoding them gives as a digest."""
    path = bpe.vocabulary_path()
    coded = bpe.encode_documents(docs.select("doc_id", "text", "lang", "source"), path).drop("text")
    back = bpe.decode_documents(coded, path)
    return back.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language", keep_known_languages),
    ("lines", drop_repeated_lines),
    ("near-copies", keep_one_of_near_copies),
    ("mix", mix),
    ("tokens", tokenise),
]
#: Languages, fingerprints, components and tokens are beyond SQL; tests hold each stage against brute force on its own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents; each stage's result is written as a table and read by the next.

    A null or wordless text has no language and goes in the first stage; repeated rows are copies and one of them stays; a
    null id is larger than any other; sources that are null are one source. Texts are taken whole, whatever their length.
    Stages read the columns of documents alone, so others may have any names. An empty table gives an empty result."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_dir(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = saved(docs, folder, f"{k}-{name}")
    return docs
