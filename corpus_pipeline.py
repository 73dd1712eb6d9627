"""A corpus pipeline: five of the training-data operators, one after the other, over the table documents.

Each stage takes all rows that the stage before it kept. The stages before the last return the columns of documents;
the last adds mix_domain, mix_epoch and mix_tokens.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from payloom.llm import decontam, mixing, pii, simhash
from payloom.llm import toxicity as toxic
from payloom.llm.common import shared_folder, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go."""
    return toxic.without_toxic(docs, toxic.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (0.8 of their runs of five words alike) stays: the one with the smallest doc_id."""
    return simhash.one_of_similar(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def sanitisation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and terms that reveal it are replaced in the texts."""
    return pii.sanitise(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken up to the target weights of their sources."""
    return mixing.mixture(docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("sanitisation", sanitisation), ("mixture", mixture)]
#: The classifier's scores are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared folder and read again; what a stage was made from is then removed."""
    folder, docs, before = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        here = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(here)
        docs = spark.read.parquet(here)
        if before:
            _remove(spark, before)
        before = here
    return STAGES[-1][1](spark, docs, sf_dir)


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
