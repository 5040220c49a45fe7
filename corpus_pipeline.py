"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.llm import bpe, mixing, nearcopies, substring, toxicity
from quern.llm.shared import stored

#: Rows in an Arrow batch, at most, which bounds what a task holds of texts, however long they are.
BATCH = 1000

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _bounded(spark: SparkSession) -> None:
    """Batches of ``BATCH`` rows at most from here on: a stage's rows are computed after it has returned."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH:
        spark.conf.set(name, str(BATCH))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; the classifier learns from the labelled documents among ``docs``."""
    _bounded(spark)
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id."""
    _bounded(spark)
    return nearcopies.deduplicated(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages of 50 words and more that an earlier document has go; so do documents left without a word by it."""
    _bounded(spark)
    return substring.trimmed(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: rows repeat, end at the cut, or go, as the budget says."""
    _bounded(spark)
    return mixing.mixture(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of every row's ids and of its decoded text."""
    _bounded(spark)
    return bpe.encode_decode(docs)


STAGES: list[tuple[str, Stage]] = [("toxicity", drop_toxic), ("simhash", drop_near_copies), ("substring", drop_repeats), ("mixing", mix_sources), ("bpe", encode)]

#: Learnt weights and fingerprints have no SQL form; the tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
