"""What the operators of this subpackage share: the tables and small expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from castlist.session import bounded_batches as bounded_batches

# The white space and the letters that the contracts of the queries name.
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def lowered(text: Column) -> Column:
    """A-Z to a-z; every other letter stays."""
    return F.translate(text, UPPER, LOWER)


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of an id written as text, modulo ``divisor``; a null id counts as no text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % divisor


def wide_hash(value: Column) -> Column:
    """128 bits of a value, as two longs: XXH64 under two seeds."""
    return F.struct(F.xxhash64(value).alias("a"), F.xxhash64(F.lit(1), value).alias("b"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it, inside lambdas too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
