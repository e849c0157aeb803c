"""The corpus pipeline: language ID, quality, near-duplicates, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the
last return the columns of ``documents``.  It builds on the operators in ``cellframe.llm``.

Defined cases: documents without text or letters are of no language and go; repeated rows pass the first
two stages each and leave one; rows that share an id count as documents of their own until the last
stage; without trusted documents all with text are good; texts are read whole, however long; an empty table
gives an empty result; further columns are carried along.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cellframe.llm import language, packing, quality, simhash
from cellframe.llm.common import materialise

#: How much of two languages' phrases the runner-up must need for a document to be of one language.
LEAST_CERTAINTY = 0.505


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those whose language the automata cannot tell."""
    return language.keep_identified(docs, language.train(docs), LEAST_CERTAINTY)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the model of trusted text finds more perplexing than their language allows."""
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    return quality.keep_good(docs, trusted)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of every group of documents of five-word similarity 0.8 or more the one with the smallest id; links are verified by their shingles."""
    return simhash.distinct_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("quality_classifier", keep_quality),
    ("simhash_near_dedup", drop_near_duplicates),
    ("best_fit_packing", pack_sequences),
]

#: No stage can be put into SQL: see the brute-force version in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
