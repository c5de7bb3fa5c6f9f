"""The corpus pipeline: from the table of documents to sharded training data.

Every stage works on all that its predecessor kept. Between stages the documents are
written as Parquet in the cluster's shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from methylspark.llm import decontam, langid, mixing, sharding, simhash
from methylspark.llm.common import staged, table
from methylspark.llm.queries import SHARDS, SLOTS


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the documents' own labels; those that it rejects go.

    Null texts and those without a letter are rejected; documents without a label are not learnt
    from but judged like others. Repeated rows are judged alike. If nothing can be learnt,
    everything with a letter stays. No rows in, no rows out.
    """
    found = langid.identify(docs, langid.train(docs))
    return found.filter("not rejected").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts with a five-word similarity of 0.8 or more stays: that of the smallest id.

    Texts without words, null ones included, are alike; rows that repeat id and text are one; null
    ids are smallest. No rows in, no rows out.
    """
    return simhash.drop_near_copies(docs, n=5, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go.

    Null and empty texts and items hold nothing; without items everything stays. Repeated rows
    have one fate. No rows in, no rows out.
    """
    return decontam.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources have their target weights.

    A null source is a source, null and empty texts count no characters; rows that repeat an id draw the same
    number of copies, and so do rows without an id. No rows in, no rows out.
    """
    return mixing.mix(docs, seed=7, temperature=0.5, epochs=1.0).select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets its shard (columns ``slot`` and ``shard`` are added); copies of an id share one, and so do rows without an id. No rows in, no rows out."""
    return sharding.assign_shards(docs, SHARDS, ("doc_id",), SLOTS)


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources", mix_sources),
    ("sharding", shard),
]

#: SQL can't express the first three stages; tests compare each with a plain version on small tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, name.replace(" ", "-"))
    return docs
