"""Sharding by a permutation-filled lookup table.

Every shard has a preference order of all slots of a prime-sized table: an offset
and a step, both hashed from its name, walk through every slot once because the
size is prime. The shards take turns; each claims the first slot of its order
that is still free, until no slot is left. So every shard owns the same number
of slots but for one, and a shard that is added or removed moves few rows
besides its own. Placing a row is one hash and one look into the table, which is
broadcast: its size is the parameter ``slots``, whatever the size of the data.

Rows are placed by the columns ``keys``; a null counts as a value of its own and
equal keys meet in one shard. Where one key may hold a large part of the rows,
``spread`` deals each key's rows out over that many neighbouring slots by the
columns ``spread_by``. A table without rows gives no rows. A column of the input that has
the name of a result column is replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 65537


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def preference(shard: str, slots: int) -> tuple[int, int]:
    """The offset and the step that order all slots for a shard."""
    digest = hashlib.sha256(shard.encode()).digest()
    offset = int.from_bytes(digest[:8], "big") % slots
    step = int.from_bytes(digest[8:16], "big") % (slots - 1) + 1
    return offset, step


def lookup_table(shards: Sequence[str], slots: int = SLOTS) -> np.ndarray:
    """For every slot the index of the shard that claims it."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need distinct names")
    if not is_prime(slots) or slots < len(shards):
        raise ValueError("slots must be a prime number, no less than the shards")
    # Of each order only the next slot is kept, so memory does not grow with shards times slots.
    following = [list(preference(shard, slots)) for shard in shards]
    owner = [-1] * slots
    for turn in range(slots):
        shard = turn % len(shards)
        slot, step = following[shard]
        while owner[slot] >= 0:
            slot = (slot + step) % slots
        owner[slot] = shard
        following[shard][0] = (slot + step) % slots
    return np.array(owner, np.int32)


def slot_of(keys: Sequence[str | Column], slots: int) -> Column:
    columns = [F.col(key) if isinstance(key, str) else key for key in keys]
    parts = [x for c in columns for x in (c.isNull(), c)]
    return F.pmod(F.xxhash64(*parts), F.lit(slots)).cast("int")


def assign(
    df: DataFrame,
    shards: Sequence[str],
    keys: Sequence[str],
    slots: int = SLOTS,
    spread: int = 1,
    spread_by: Sequence[str] = (),
) -> DataFrame:
    """The rows with the columns ``slot`` and ``shard``, which replace any of these names; nothing is shuffled."""
    table = df.sparkSession.createDataFrame(
        [(i, shards[owner]) for i, owner in enumerate(lookup_table(shards, slots).tolist())],
        "place int, owner string",
    )
    slot = slot_of(keys, slots)
    if spread > 1:
        slot = F.pmod(slot + F.pmod(F.xxhash64(*spread_by), F.lit(spread)), F.lit(slots))
    kept = [c for c in df.columns if c not in ("slot", "shard")]
    # The other columns travel in one, so that no name can clash.
    placed = df.select(F.struct(*kept).alias("row"), slot.cast("int").alias("slot"))
    placed = placed.join(F.broadcast(table), F.col("slot") == F.col("place"))
    return placed.select(*(F.col("row")[c].alias(c) for c in kept), "slot", F.col("owner").alias("shard"))


def write_shards(assigned: DataFrame, path: str, files_per_shard: int = 1) -> None:
    """One folder of Parquet files for every shard; ``files_per_shard`` bounds the load of a task."""
    part = F.pmod(F.xxhash64("slot", F.monotonically_increasing_id()), F.lit(files_per_shard))
    assigned.repartition("shard", part).write.partitionBy("shard").parquet(path)
