"""Finding heavy keys, and spreading their rows over many tasks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from castlist.session import cut_lineage

# A key with more rows than one task should hold or sort is split into parts.
ROWS_PER_TASK = 1_000_000
# Tables with an entry per heavy key are broadcast up to this many keys.
BROADCAST_KEYS = 1000


@dataclass(frozen=True)
class HeavyKeys:
    """A stored table (key, size, parts) of all keys that need splitting; size is the number of rows."""

    table: DataFrame
    count: int

    def sided(self, per_key: DataFrame) -> DataFrame:
        """A table bounded per heavy key, hinted for broadcast if the keys are few."""
        return F.broadcast(per_key) if self.count <= BROADCAST_KEYS else per_key


def heavy_keys(df: DataFrame, key: str, rows_per_task: int = ROWS_PER_TASK) -> HeavyKeys | None:
    """All keys with more than rows_per_task rows; None, as usual, if there are none.

    One partially aggregated pass over the key column.
    """
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("size"))
    heavy = sizes.where(F.col("size") > rows_per_task).select(
        key, "size", F.ceil(F.col("size") / rows_per_task).cast("int").alias("parts")
    )
    table = cut_lineage(heavy)
    count = table.count()
    return HeavyKeys(table, count) if count else None


def with_parts(df: DataFrame, key: str, heavy: HeavyKeys | None) -> DataFrame:
    """Add ``parts``, the number of parts of each row's key (1 if it is light)."""
    if heavy is None:
        return df.withColumn("parts", F.lit(1))
    joined = df.join(heavy.sided(heavy.table.select(key, "parts")), key, "left")
    return joined.withColumn("parts", F.coalesce("parts", F.lit(1)))
