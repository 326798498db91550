"""Entity-day tables kept by year and entity, so that history windows need no exchange and a year's query reads a year."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_days(df: DataFrame, table: str, buckets: int) -> None:
    """df (entity_id, day, date, more) as a managed table: a folder a year, in it `buckets` files by entity, each in order of days.

    Rows are dealt by entity first, so a bucket of a year is one file. As many buckets as the cluster has tasks at once are
    enough; joins between tables of equal buckets need no exchange either.
    """
    dealt = df.withColumn("year", F.year("date")).repartition(buckets, "entity_id")
    dealt.write.mode("overwrite").partitionBy("year").bucketBy(buckets, "entity_id").sortBy("entity_id", "day").saveAsTable(table)


def read_days(spark: SparkSession, table: str, years: tuple[int, int] | None = None) -> DataFrame:
    """The table, or its years from the first to the last: other years' folders are not listed."""
    rows = spark.table(table)
    return rows if years is None else rows.where(F.col("year").between(*years))
