"""Sharding: shards take turns claiming slots of a prime-sized table in their own preference order.

Each shard's order is a permutation (offset + j * step) mod size drawn from hashes of its name; on its turn a shard
takes the first slot of its order that is free. Shares differ by one slot at most, and a changed list of shards moves
few slots. The table depends on the two parameters alone, so broadcasting it is bounded by `size`.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rampart.llm.common import free_name

SHARDS = tuple(f"shard-{i:02d}" for i in range(32))
SIZE = 4099


def _digits(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(shards: tuple[str, ...] = SHARDS, size: int = SIZE) -> list[int]:
    """The number of the shard that owns each slot."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be different names, one at least")
    if size < 3 or any(size % k == 0 for k in range(2, int(size**0.5) + 1)) or size < len(shards):
        raise ValueError("size must be a prime of at least the number of shards")
    order = [(_digits(f"{s}/offset") % size, _digits(f"{s}/step") % (size - 1) + 1) for s in shards]
    owner, tried = [-1] * size, [0] * len(shards)
    for turn in range(size):
        i = turn % len(shards)
        start, step = order[i]
        while owner[slot := (start + tried[i] * step) % size] >= 0:
            tried[i] += 1
        owner[slot] = i
    return owner


def slot_of(key: Column, size: int = SIZE) -> Column:
    """The slot of a key: 60 bits of its MD5 modulo the size; a null key counts as the empty string."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(size)).cast("int")


def place(df: DataFrame, key: str = "doc_id", shards: tuple[str, ...] = SHARDS, size: int = SIZE) -> DataFrame:
    """df with columns slot and shard (with underscores before a name that df has already).

    Equal keys go to one shard, repeated rows included; null keys go where the empty string goes; an empty table
    stays empty. Nothing is shuffled: the table of `size` rows is broadcast.
    """
    spark = df.sparkSession
    slot, shard = free_name(df, "slot"), free_name(df, "shard")
    owners = F.split(F.lit(",".join(shards[i] for i in lookup_table(shards, size))), ",")
    table = spark.range(1).select(F.posexplode(owners).alias(slot, shard))
    at = df.withColumn(slot, slot_of(F.col(f"`{key}`"), size))
    return at.join(F.broadcast(table), slot).select(*(F.col(f"`{c}`") for c in df.columns), slot, shard)
