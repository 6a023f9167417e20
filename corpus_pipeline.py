"""From raw documents to a mixed, deduplicated, pseudonymised and tokenised corpus, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of documents; the
last adds n_tokens and ids. `run` keeps each stage's rows as Parquet in the folder the cluster shares, and reads them
again for the next one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, mixing, pii, simhash, toxicity
from tessera.llm.common import read, shared_folder

#: No document more than twice; every document once at least, so that no clean one is lost to the weights.
MIX = mixing.Mix(max_repetition=2.0)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fit on the labelled documents that are not held out; documents that score 0.5 or more go."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, toxicity.learnable(read(spark, sf_dir, "labels"))))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of documents linked by their fingerprints the one with the least id stays."""
    return simhash.keep_first(docs)


def pseudonymised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each epoch that takes a document: small sources come up to twice."""
    return mixing.mix(docs, MIX).select(*docs.columns)


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """ids and n_tokens; the text is decoded from the ids."""
    return bpe.tokenise(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("simhash_near_dedup", without_near_copies),
    ("pii", pseudonymised),
    ("source_mixing", mixed),
    ("bpe", tokenised),
]

#: A classifier, a graph of fingerprints, keyed pseudonyms and merges are beyond SQL; tests hold `run` against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
