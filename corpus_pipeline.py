"""From raw documents to shards: quality, near duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are written as Parquet and read again
as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glyphmill.llm import decontamination, mixing, quality_model, sharding, simhash
from glyphmill.llm.common import materialize, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the boosted trees take for good ones; fitted as in op2, without its held-out labels."""
    labels = table(spark, sf_dir, "labels")
    model = quality_model.train(docs, labels.where(quality_model.remainder("doc_id", 3) != 1))
    return quality_model.keep_good(docs, model)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each SimHash component."""
    return simhash.keep_one(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose benchmark words stay under a twentieth."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: 0 to 2 times."""
    return mixing.apply_mix(docs)


def place_in_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with size, text_crc32, shard and slot."""
    return sharding.shard_documents(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("simhash near-dedup", keep_one_of_each_group),
    ("benchmark decontamination", keep_uncontaminated),
    ("source mixing", mix_sources),
    ("sharding", place_in_shards),
]

#: Boosted trees, XXH64 fingerprints and the capacity search have no SQL form; tests/llm checks run() by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
