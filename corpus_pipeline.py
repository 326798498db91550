"""The corpus pipeline: quality, near-duplicates, personal data, mixing and packing, one stage after the other.

Every stage works on all that its predecessor kept. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecal.llm import mixing, packing, pii, quality_model, simhash
from tidecal.llm.common import run_dir, ship_package


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    Null and empty texts are scored like any other; repeated rows and repeated ids are each judged by their own text.
    """
    ship_package(spark)
    model = quality_model.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    nested = docs.select(F.struct(*docs.columns).alias("row"), "text")
    kinds = T.StructType([*nested.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    scored = nested.mapInPandas(quality_model.score_batches(model), kinds)
    return scored.where("predicted = 1").select("row.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicate texts: the one with the smallest id, a null id last.

    Null and empty texts are one group; of rows equal in text and id any one stays. Rows that share an id but not a text
    are told apart.
    """
    return simhash.one_of_each(docs)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same rows with personal data replaced by its kind; null texts stay null."""
    return pii.redact(docs, pii.fit(docs))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it: repeated rows count each, a null source is a source of its own."""
    return mixing.emit(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length bucket and batch of every row; repeated rows are packed each, null texts have no tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("PII", personal_data_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL expresses neither the trained models nor the fingerprints.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    top = f"{run_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{k}")
        docs = spark.read.parquet(f"{top}/{k}")
    return docs
