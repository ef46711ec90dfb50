"""A training corpus from documents: STAGES in order, each written as Parquet and reread.

Toxic documents go, one document of each near-duplicate group (five-word shingles, 0.8 or
more) stays, documents that hold benchmark items go, sources are mixed to their target weights, and what is left
is dealt to shards.  All stages but the last return the columns of documents; the last
adds size, text_crc32, law, shard, grown_shard and slot.

Copies that mixing makes have their document's doc_id, so they go to one shard with
slots of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from novelspark.llm import decontaminate, mixing, neardup, sharding, toxicity
from novelspark.llm.common import stored, table


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_first(docs, ngram=5, percent=80)


def _decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def _mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.replicate(docs, mixing.source_rates(docs)).select(*docs.columns)


def _sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard(docs, sharding.Topology.regular(sharding.SHARDS))


STAGES = [
    ("toxicity", _toxicity),
    ("n-gram Jaccard join", _near_duplicates),
    ("benchmark decontamination", _decontamination),
    ("mixing", _mixing),
    ("sharding", _sharding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


#: Toxicity and templates are not SQL; a test runs all stages against plain Python.
ORACLE_SQL = None
