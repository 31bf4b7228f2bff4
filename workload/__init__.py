"""The registered queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from castlist.session import ship_package
from castlist.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Over how many tasks the tables are spread; None leaves them as they are scanned.
# For the benchmark, whose tables are single small files.
TASKS: int | None = None

# The stand-in for a model finds these in a text.
NAME_PATTERN = "[A-Z][a-z]{3,}"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def register(run: Query) -> Query:
        def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
            return run(ship_package(spark), sf_dir)

        QUERIES[run.__name__] = shipped
        if sql is not None:
            ORACLES[run.__name__] = sql
        return run

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text)."""
    table = read_table(spark, f"{sf_dir}/documents.parquet", "doc_id", tasks=TASKS)
    return table.select("doc_id", "text")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns in the shape of chunks: (doc_id, chunk_idx, chunk)."""
    table = read_table(spark, f"{sf_dir}/conversations.parquet", "conv_id", "turn", tasks=TASKS)
    return table.selectExpr(
        "conv_id AS doc_id", "CAST(turn AS INT) AS chunk_idx", "text AS chunk"
    )
