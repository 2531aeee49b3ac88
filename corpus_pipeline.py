"""From raw documents to packed sequences, one stage after another.

Every stage takes what the one before kept, as a written table, and decides on all of it. All but
the last return the columns of ``documents``. Each stage treats nulls, empty texts, ties, repeated
rows and empty tables as its operator's module says; other columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogops.llm import language, minhash, packing, quality
from catalogops.llm.registry import free, table
from catalogops.plans.durable import durable
from catalogops.session import small_batches, tune


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a learned language explains; those without any letter go."""
    small_batches(spark)
    found = language.identify(docs, language.learn(docs))
    (lang_pred,) = free(["lang_pred"], docs.columns)
    return found.where(F.col(lang_pred) != "und").select(*docs.columns)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score ``THRESHOLD`` or more."""
    small_batches(spark)
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    (score,) = free(["quality_score"], docs.columns)
    return scored.where(F.col(score) >= quality.THRESHOLD).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, the one with the least id."""
    small_batches(spark)
    return minhash.deduplicated(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences."""
    import public_tokenizers

    small_batches(spark)
    return packing.pack(packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [("language", known_language), ("quality", good_quality), ("near_duplicates", one_of_each), ("packing", packed)]

# Neither the classifiers nor the sketches can be stated in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    sf_dir = sf_dir.rstrip("/")
    docs = table(tune(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
