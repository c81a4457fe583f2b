"""The corpus pipeline: quality rules, quality classifier, near-duplicates, personal data, packing.

Each stage takes all documents that its predecessor kept and returns rows with the columns of documents; the last returns
the packed pieces. run() writes each stage's rows into the shared folder and reads them back for the next.

Null, empty and blank texts fail the quality rules and go there; texts are read whole, however long. Repeated rows and near
copies are one class, of which the row with the smallest id stays, then that with the smallest hash; rows with null ids are
linked like others. An empty table gives no rows. Columns beyond those of documents, of any name, stay until packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import lines, neardup, packing, pii, pu
from corvane.llm.common import table
from corvane.llm.queries import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.keep(docs, lines.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pu.keep(docs, pu.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.deduplicate(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.mask(docs, pii.train(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.best_fit(docs, vocabulary())


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can't express the trained stages; tests/llm/test_pipeline.py holds run() against a version by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES):
            docs = table(docs, name)
    return docs
