"""Documents to packed training sequences: language ID, exact dedup, near dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last
return the columns of documents. ORACLE_SQL is None: SQL can express neither the network nor the
packing; tests/llm holds each stage against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import exact_dedup, langid, near_sets
from tessella.llm.queries import packed
from tessella.llm.store import fresh, materialise
from tessella.session import ship

#: A document whose language is predicted with less than this mean probability is rejected, as is one
#: without any letter. With four languages a guess has 0.25. What binds for any number of languages is
#: that the text must look like the predicted one (langid.Familiar).
LEAST_SCORE = 0.3
PER_LANGUAGE = 512


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that have no letters, in which no language stands out or which aren't in a learned
    language. Without any labelled document only those without letters go."""
    ship(spark)
    texts, labels = langid.training_sample(docs.where(~langid.is_held_out(F.col("doc_id"))), "doc_id", "text", "lang", PER_LANGUAGE)
    if not texts:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    (judged,) = fresh(docs, "judged")
    rows = docs.withColumn(judged, langid.judged(F.col("text"), langid.train(texts, labels), langid.familiarise(texts, labels)))
    kept = (F.col(f"{judged}.lang_pred") != langid.UNKNOWN) & (F.col(f"{judged}.score") >= LEAST_SCORE) & F.col(f"{judged}.familiar")
    return rows.where(kept).drop(judged)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest doc_id stays."""
    return exact_dedup.exact_dedup(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group (links at a 5-word Jaccard similarity of 0.8) the document with the
    smallest doc_id stays.

    Operator 8's fingerprints, covering anchors and components find near copies at three bits or fewer, which are
    checked by the shingles themselves. Of 64 bits, pairs at 0.8 are expected about ten apart, and no covering code
    brings those together with few replicas: what is left is found exactly, by prefix filtering over the shingles.
    """
    ship(spark)
    return near_sets.keep_one(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of 2048 tokens."""
    ship(spark)
    return packed(docs)


STAGES = [("language_id", language_id), ("exact_dedup", exact_duplicates), ("simhash_near_dedup", near_duplicates), ("packing", pack_sequences)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
