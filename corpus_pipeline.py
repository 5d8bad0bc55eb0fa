"""Documents to token ids: toxicity, near-duplicates, benchmark decontamination, mixing, token-id output.

Every stage takes (spark, docs, sf_dir) and works on all documents that the stage before it kept; all but the last give
the columns of ``documents``.  ``run`` writes each result as Parquet below the shared folder and reads it again.

Each stage has the defined cases of its operator; documents that a stage has nothing against (null and empty texts, rows
without an id) stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helioframe.llm import decontaminate, mixing, near_dedup, tokenids, toxicity
from helioframe.session import cut_lineage
from helioframe.sources.tables import table


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labelled ones, does not score over one half; all where it learnt nothing."""
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.where(F.col("score") <= 0.5).select("row.*")


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_dedup.dedup(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return decontaminate.remove_documents(decontaminate.scan(docs, table(spark, sf_dir, "benchmark")))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the source weights take it."""
    return mixing.mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token-id files, read back: doc_id, start, n_tokens, ids_crc32."""
    import public_tokenizers

    return tokenids.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", not_toxic), ("near_dedup", distinct), ("decontamination", clean), ("mixing", mixed), ("token_ids", token_ids)]

#: A trained classifier and a tokenizer are outside SQL; the tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return docs
