"""A corpus pipeline over `documents`: quality, near-duplicates, contamination, mixture, shards.

STAGES are applied in order; between them the rows are written as Parquet and read again. Each
function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of
`documents`.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import decontaminate, mixing, neardup, quality, sharding
from tideline.llm.common import remove, shared_folder, small_batches, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on all labels, does not reject."""
    return quality.keep(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the least id."""
    return neardup.keep_one(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than 5 % are in windows of benchmark items, without these windows."""
    rows = decontaminate.clean(docs, decontaminate.build(table(spark, sf_dir, "benchmark")))
    if "n_chars" in docs.columns:  # the cut texts are shorter
        rows = rows.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))
    return rows


def to_target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of sources takes them."""
    return mixing.mixed(docs)


def into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every record's shard and slot, with its text, language and source."""
    return sharding.shard(docs, carry=["text", "lang", "source"])


STAGES: list[tuple[str, Stage]] = [
    ("quality", good_quality),
    ("near-duplicates", one_of_each_group),
    ("decontamination", uncontaminated),
    ("mixture", to_target_weights),
    ("shards", into_shards),
]

#: Boosted trees, sampled components and seeded choices are not for SQL; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Stages are written below the session's checkpoint folder, which all executors share.

    A stage's table is removed once the next one is written; the last stays, as the result reads it.
    Null and empty texts, repeated rows, null ids and empty tables are what the stages' operators say
    of them; extra columns of `documents` are kept by all but the last stage.
    """
    folder, last = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}", None
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        with small_batches(spark):  # whole rows pass through Python in three stages
            docs = stage(spark, docs, sf_dir)
            if i < len(STAGES) - 1:
                docs.write.parquet(f"{folder}/{i}-{name}")
        if i < len(STAGES) - 1:
            docs = spark.read.schema(docs.schema).parquet(f"{folder}/{i}-{name}")
            if last:
                remove(spark, last)
            last = f"{folder}/{i}-{name}"
    return docs
