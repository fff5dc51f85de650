"""From raw documents to sharded training text: five stages, each an operator of ``pictora.llm``.

Each stage takes the documents its predecessor kept, as Parquet, and all but the last return the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pictora.llm import decontaminate, langid, mixing, near_copies, shards
from pictora.llm.common import only, scratch, table

#: Share of a document's text that its main language must have.
LEAST_LANGUAGE = 0.3
#: Tokens the mix takes, as a share of what it is given.
SHARE = 0.8


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have letters and a language with at least the given share of the text; those in two languages stay."""
    return langid.accepted(docs, langid.fit(docs), LEAST_LANGUAGE)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: SimHash over five-word shingles, a checked similarity of 0.8 or more, no link lost."""
    return near_copies.representatives(docs, near_copies.near_copies(docs))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    found = decontaminate.overlaps(docs, table(spark, sf_dir, "benchmark"))
    return only(docs, found, "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at equal weights within languages and domains; documents are taken once at most."""
    chosen = mixing.select(docs, share=SHARE, max_epochs=1)
    return only(docs, chosen.where("epochs = 0"), "left_anti")


def deal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with its shard of 40."""
    return shards.descend(docs, "doc_id", shards.topology(40))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify),
    ("near_dedup", deduplicate),
    ("decontamination", decontaminated),
    ("mixing", mix),
    ("sharding", deal),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet to the shared folder and read again."""
    docs, folder = table(spark, sf_dir, "documents"), f"{scratch(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: The first stage learns a model and the second hashes with XXH64, which SQL here lacks; the tests hold run() against brute force.
ORACLE_SQL = None
