"""Sharding by a permutation-filled lookup table.

Every shard has a preference order over the slots of a table whose size is a prime: offset, offset + skip, ... modulo the size. Shards
take turns; at its turn a shard claims the first slot of its order that is still free. A row goes to the shard that holds the slot of
its key's hash. Shards get the same number of slots give or take one, and when a shard leaves, few of the other shards' slots move.

Only the table (a size fixed by a parameter) is made on the driver; rows are placed by DataFrame functions and a broadcast join with that
table, without a shuffle, so a hot key or source costs nothing.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import unused


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def next_prime(n: int) -> int:
    while not _is_prime(n):
        n += 1
    return n


def lookup_table(shards: list[str], size: int) -> list[int]:
    """The shard's index for each slot. ``size`` must be a prime and no less than the number of shards; names must differ."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be named differently, and there must be one at least")
    if not _is_prime(size) or size < len(shards):
        raise ValueError("the size must be a prime, and no less than the number of shards")
    digests = [hashlib.sha256(name.encode()).digest() for name in shards]
    at = [int.from_bytes(d[:8], "big") % size for d in digests]
    skip = [int.from_bytes(d[8:16], "big") % (size - 1) + 1 if size > 2 else 1 for d in digests]
    table = [-1] * size
    left = size
    while left:
        for i in range(len(shards)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % size
            table[at[i]] = i
            left -= 1
            if not left:
                break
    return table


def slot_of(key: Column, size: int) -> Column:
    """The slot of a key: the first 32 bits of the MD5 of its text, modulo the size. A null key has the slot of the empty string."""
    return (F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long") % size).cast("int")


def table_frame(spark: SparkSession, shards: list[str], size: int) -> DataFrame:
    """The table as (slot, shard)."""
    text = "[" + ",".join(map(str, lookup_table(shards, size))) + "]"
    return spark.range(1).select(F.posexplode(F.from_json(F.lit(text), "array<int>")).alias("slot", "shard"))


def place(df: DataFrame, key: str, shards: list[str], size: int, slot: str = "slot", shard: str = "shard") -> DataFrame:
    """``df`` with the columns ``slot`` and ``shard``.

    Null keys go where the empty string goes; repeated rows go to one shard; an empty table gives an empty result. A column of ``df``
    that has the name of an output column is replaced.
    """
    own_slot, own_shard = unused("__slot", df), unused("__shard", df)
    table = table_frame(df.sparkSession, shards, size).select(F.col("slot").alias(own_slot), F.col("shard").alias(own_shard))
    kept = [c for c in df.columns if c not in (slot, shard) or c == key]
    placed = df.select(*kept, slot_of(F.col(key), size).alias(own_slot)).join(F.broadcast(table), own_slot)
    return placed.select(*kept, F.col(own_slot).alias(slot), F.col(own_shard).alias(shard))


def write_shards(df: DataFrame, key: str, shards: list[str], size: int, path: str) -> None:
    """Write each shard to a folder of its own; rows stay in their tasks, so a hot shard is written by many of them."""
    place(df, key, shards, size).drop("slot").write.partitionBy("shard").parquet(path)
