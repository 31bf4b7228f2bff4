"""Turning arrays into rows without computing the array twice.

For a plain explode Spark infers a filter "the array is not empty" and pushes
it down with a copy of the expression that makes the array, Python calls
included. The outer form has no such filter; the row it adds for an empty
array is dropped afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_items(df: DataFrame, keep: list[str], array: Column, pos: str, item: str) -> DataFrame:
    """Rows (*keep, pos, item), one per array element, pos from 0."""
    exploded = df.select(*keep, F.posexplode_outer(array).alias(pos, item))
    return exploded.where(F.col(pos).isNotNull())


def inline_structs(df: DataFrame, keep: list[str], array: Column, required: str) -> DataFrame:
    """Rows (*keep, *fields), one per struct; ``required`` is a field never NULL."""
    exploded = df.select(*keep, F.inline_outer(array))
    return exploded.where(F.col(required).isNotNull())
