"""A training corpus from documents: quality filter, near-dedup, decontamination, source mixing, training order.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's docs.

Defined results: null and empty texts are judged like others by the classifier, are near copies of each
other, hold no benchmark item, count one token and become an end mark; of repeated rows one stays in the
second stage; a null source is a source; an empty table passes through and gives no sequence; columns
beside doc_id, text and source are kept, whatever their names, up to the last stage, which returns
sequences.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from sparsella.llm.common import settled
from sparsella.llm.decontaminate import without_leaks
from sparsella.llm.mixing import mixture
from sparsella.llm.nbsvm import accepted
from sparsella.llm.neardup import one_of_each
from sparsella.llm.training_order import materialised


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixture(docs)


def training_order(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return materialised(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", source_mixing),
    ("token-ID / binary output", training_order),
]

#: SQL cannot express the classifier's fit; the stages are tested against brute force in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's input, and what it stored on its way, are deleted once its result is whole."""
    docs, spent = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for i, (_, stage) in enumerate(STAGES):
        docs = settled(partial(stage, spark, docs, sf_dir), f"stage-{i}", spent)
    return docs
