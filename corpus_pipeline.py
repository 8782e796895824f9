"""The corpus pipeline: reject toxic documents, drop exact and near copies, mix the sources, encode what is left.

Each stage takes the documents that its predecessor kept and returns them with the columns of documents; the last one
returns doc_id, n_tokens, ids_sha256 and decoded_sha256. Between stages the rows are written as Parquet and read again.
The mixing stage writes the rows of each output shard together, in the order of its local shuffle.

Defined results: nulls in any column, empty and very long texts, repeated rows, ties and extra columns are handled by each
stage as its operator says; rows keep all their columns up to the last stage; empty documents give no rows.
SQL can express neither the learned scores nor the encoding, so the stages are tested against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from treelake.llm import bpe, exact_dedup, mixing, simhash, toxicity
from treelake.llm.common import stored, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject_toxic(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mixed(docs)
    shard, place = mixed.columns[-2:]
    return mixed.repartition(mixing.SHARDS, shard).sortWithinPartitions(shard, place).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(docs, bpe.default_vocabulary())


STAGES = [
    ("toxicity", reject_toxic),
    ("exact dedup", drop_exact_copies),
    ("simhash near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
