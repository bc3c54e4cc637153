"""Sharding by a permutation-filled lookup table.

Every shard has a preference order over the slots of a table of prime size: it starts at a
slot of its own and goes on by a step of its own.  Shards take turns, each claiming its
first free slot, until the table is full.  A key's hash picks a slot, and the slot names
the shard.  Shards hold equal shares, within one slot, and when a shard comes or goes few
keys move between the others.

The table has ``slots`` rows, a parameter, so it is broadcast whatever the data.  A null
key counts as empty text.  Equal keys meet in a shard, hot ones too: a shard is a folder,
not a task, and ``write_shards`` deals its rows to several tasks.  Repeated rows go where
their key goes; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARDS = 64
#: A prime about a hundred times the number of shards.
SLOTS = 6421
#: The largest table that may be broadcast.
MAX_SLOTS = 1_000_003


def _hash(text: str, salt: str) -> int:
    return int(hashlib.md5(f"{salt}{text}".encode()).hexdigest()[:15], 16)


def fill(names: list[str], slots: int) -> list[int]:
    """The number of the shard of every slot."""
    if not names or len(set(names)) < len(names):
        raise ValueError("shards need distinct names")
    if slots < len(names) or slots > MAX_SLOTS or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"slots must be a prime from the number of shards to {MAX_SLOTS}")
    start = [_hash(n, "start ") % slots for n in names]
    step = [_hash(n, "step ") % (slots - 1) + 1 for n in names]
    table, taken = [-1] * slots, 0
    while True:
        for k in range(len(names)):
            while table[start[k]] >= 0:
                start[k] = (start[k] + step[k]) % slots
            table[start[k]] = k
            taken += 1
            if taken == slots:
                return table


def slot_of(key: Column, slots: int) -> Column:
    """The slot of a key."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def assign_shards(df: DataFrame, key: str, names: list[str], slots: int = SLOTS,
                  shard: str = "shard", slot: str = "slot") -> DataFrame:
    """The rows with their slot and their shard's name; columns of the input with these names are replaced."""
    table = df.sparkSession.createDataFrame(
        [(i, names[k]) for i, k in enumerate(fill(names, slots))], f"`{slot}` int, `{shard}` string")
    return df.withColumn(slot, slot_of(F.col(key), slots)).drop(shard).join(F.broadcast(table), slot)


def write_shards(assigned: DataFrame, path: str, tasks_per_shard: int = 8, shard: str = "shard") -> None:
    """Write a folder per shard; each shard's rows are dealt to several tasks by their contents.

    What is still large then, as of rows that are equal in all columns, is split by where the rows come from.
    """
    part = F.pmod(F.xxhash64(*[c for c in assigned.columns if c != shard]), F.lit(tasks_per_shard))
    dealt = assigned.withColumn("_shard_part", part).hint("rebalance", F.col(shard), F.col("_shard_part"))
    dealt.drop("_shard_part").write.partitionBy(shard).mode("overwrite").parquet(path)
