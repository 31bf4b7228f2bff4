"""Connected components of links between rows, each named by its smallest member.

Rounds of two steps (large star, small star): every node tells its larger
neighbours, then its smaller ones, of the smallest node it knows. A hub's
neighbours are never gathered: the smallest is found by partial aggregation and joined
back. The links shrink to stars; every round is written to the shared folder, so a lost executor costs a round
at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from castlist.session import cut_lineage


def _step(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a, b) with a > b, to the next such edges."""
    if large:
        towards = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
    else:
        towards = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = towards.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    joined = towards.join(least, "u")
    if large:
        new = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        new = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(
            least.select(F.col("u").alias("a"), F.col("m").alias("b"))
        )
    return new.where("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node that has a link in (a, b); components of others are themselves."""
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = cut_lineage(edges.where("a > b").distinct())
    seen = None
    while True:
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == seen:
            break
        seen = state
        edges = cut_lineage(_step(_step(edges, large=True), large=False))
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
