"""Parquet tables of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str, *key: str, tasks: int | None = None) -> DataFrame:
    """A Parquet table, as it is scanned, or spread over ``tasks`` by its unique ``key``.

    A small file is read by a few tasks only, often by one, which is slow for
    the text functions; whoever knows that a table is small may spread it.
    """
    table = spark.read.parquet(path)
    return table if tasks is None else table.repartition(tasks, *key)
