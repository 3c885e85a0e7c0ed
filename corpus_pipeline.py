"""The training-corpus pipeline: quality, near-duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet in the shared folder and reread as the next one's
docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parlance.llm import mixing, quality, sharding, simhash, tiling
from parlance.llm.common import materialise, passing, release, spread, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that the ordinal classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: its Gray-order index and an exact check, completed by an exact search; one document of each group of near copies stays."""
    return simhash.drop_similar(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that hold benchmark items go."""
    return tiling.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents as often as the mix takes them."""
    return mixing.mix_documents(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: all columns and the shard and slot of every document."""
    return sharding.shards(docs)


STAGES = [("quality", good_quality), ("near_duplicates", without_near_copies), ("decontamination", without_benchmark), ("mixing", mixed), ("sharding", sharded)]

#: No SQL: the classifier, the index and the histogram sort aren't expressible in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table. Tables that a stage leaves behind are deleted once its output is written, and that once the next has read it."""
    docs = spread(table(spark, sf_dir, "documents"))
    for name, stage in STAGES[:-1]:
        before = getattr(docs, "stored_at", None)
        with passing(spark) as left:
            docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
            left.remove(docs.stored_at)
        if before:
            release(spark, before)
    return STAGES[-1][1](spark, docs, sf_dir)
