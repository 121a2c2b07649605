"""The corpus pipeline: toxicity, quality, near-duplicates, benchmark decontamination, token encoding.

Each stage is a function of the session, the documents its predecessor kept and the folder of the tables. Stages that
filter return the columns of ``documents`` unchanged. Classifiers learn from the labelled rows of the documents that
reach their stage; a document is rejected at a score of one half.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.llm import bpe, decontamination, near_dup, quality, toxicity
from skyledger.llm.common import table
from skyledger.session import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose nearest labelled examples do not speak for toxicity."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return toxicity.score(docs, model, out="_toxicity").filter(F.col("_toxicity.score") < 0.5).select(COLUMNS)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive model scores as good."""
    model = quality.train(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return quality.score(docs, model, out="_quality").filter(F.col("_quality") >= 0.5).select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that of the smallest id."""
    return near_dup.keep_one(docs).select(COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lie in benchmark windows."""
    return decontamination.remove_documents(docs, table(spark, sf_dir, "benchmark")).select(COLUMNS)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document (little-endian unsigned 32-bit integers), checked by decoding."""
    vocabulary = bpe.share(spark, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    encoded = bpe.encode(docs, vocabulary).select(*COLUMNS, "bpe.ids", "bpe.n_tokens")
    decoded = bpe.decode(encoded, vocabulary)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return decoded.select("doc_id", "lang", "source", "n_chars", "n_tokens", F.col("ids").alias("token_ids"),
                          (F.col("decoded") == text).alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", encode_tokens),
]

# Classifiers, sketches and merges have no SQL form; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each to the stored result of the one before."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
