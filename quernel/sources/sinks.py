"""Sinks: the chunk table and the content-addressed parent table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Appends chunks, partitioned by collection."""
    chunks.write.mode("append").partitionBy("origin").parquet(path)


def read_collections(spark: SparkSession, path: str) -> DataFrame:
    """Both collections, told apart by ``origin``."""
    return spark.read.parquet(path)


def new_parents(existing: DataFrame, parents: DataFrame) -> DataFrame:
    """Parent blocks that are not stored yet, once each."""
    return parents.dropDuplicates(["parent_ref"]).join(existing.select("parent_ref"), "parent_ref", "left_anti")


def upsert_parents(existing: DataFrame, parents: DataFrame, path: str) -> None:
    new_parents(existing, parents).write.mode("append").parquet(path)
