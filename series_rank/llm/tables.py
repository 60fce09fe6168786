"""The given tables, as the queries of this package read them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from series_rank.llm.shipping import ship


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
