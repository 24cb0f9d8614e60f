"""Sharding by a permutation-filled lookup table.

Each shard has a preference order over the slots of a prime-sized table, an arithmetic progression
that its name decides; the shards take turns claiming their next free slot until none is free. A key
is hashed to a slot and finds its shard there. The table has `slots` entries whatever the data, so it
is broadcast; adding or removing a shard moves few keys between the others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, prefix

SLOTS = 65_537
SHARDS = tuple(f"shard-{k:03d}" for k in range(256))


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def fill(shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> list[int]:
    """The shard number in each slot."""
    if not _is_prime(slots) or not 0 < len(shards) < slots or len(set(shards)) < len(shards):
        raise ValueError("slots has to be a prime above the number of shards, whose names differ")
    digest = [hashlib.md5(s.encode()).digest() for s in shards]
    place = [int.from_bytes(d[:8], "big") % slots for d in digest]
    skip = [int.from_bytes(d[8:], "big") % (slots - 1) + 1 for d in digest]
    owner = [-1] * slots
    free = slots
    while free:
        for k in range(len(shards)):
            while owner[place[k]] >= 0:
                place[k] = (place[k] + skip[k]) % slots
            owner[place[k]] = k
            free -= 1
            if not free:
                break
    return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot that the first 60 bits of the key's MD5 digest lead to."""
    return F.pmod(F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long"), F.lit(slots))


def lookup(spark: SparkSession, shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """__slot, __shard and __shard_name: the table, of `slots` rows."""
    owner = fill(shards, slots)
    return spark.createDataFrame([(s, k, shards[k]) for s, k in enumerate(owner)], "__slot long, __shard int, __shard_name string")


def place(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """docs with __slot, __shard and __shard_name, in one pass without a shuffle; with more underscores if
    docs has such names.

    Rows that repeat a key share its shard. Rows without a key are spread by their text, so that many
    of them don't meet in one shard; null texts count as empty there.
    """
    p = prefix(docs.columns)
    k = F.coalesce(F.concat(F.lit("k"), column(key).cast("string")), F.concat(F.lit("t"), F.coalesce(column(text), F.lit(""))))
    names = [p + x for x in ("slot", "shard", "shard_name")]
    table = F.broadcast(lookup(docs.sparkSession, shards, slots).toDF(*names))
    return docs.withColumn(names[0], slot_of(k, slots)).join(table, names[0]).select(*map(column, docs.columns), *names)


def write(placed: DataFrame, path: str) -> None:
    """What place() gave: one folder per shard, each written by as many tasks as hold its rows."""
    *kept, _, _, name = placed.columns
    placed.select(*map(column, kept), column(name)).write.partitionBy(name).parquet(path)
