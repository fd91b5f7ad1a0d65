"""Placement of rows on shards by a permutation-filled lookup table.

Every shard orders the slots of a prime-sized table by a permutation of its
own and the shards take turns, each claiming its best free slot, until no slot
is free. A row's key hashes to a slot; the slot names the shard. When a shard
leaves, only its slots (and few others) change hands.

The table has a fixed number of slots, so its broadcast has a proven size
whatever the rows are, and placement costs no shuffle.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A prime; about a thousand slots for each of 64 shards keep shares within a few per cent.
SLOTS = 65537
SHARDS = 64


def _prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def preferences(name: str, slots: int) -> tuple[int, int]:
    """Offset and step of a shard's permutation of the slots."""
    text = name.encode()
    return zlib.crc32(b"offset:" + text) % slots, zlib.crc32(b"step:" + text) % (slots - 1) + 1


def lookup_table(shards: list[str], slots: int = SLOTS) -> np.ndarray:
    """For each slot the position of its shard in `shards`.

    slots must be a prime that is not below the number of shards, and shard
    names must differ, as equal names would have equal preferences.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need different names, one at least")
    if not _prime(slots) or slots < len(shards):
        raise ValueError("the number of slots must be a prime, not below the number of shards")
    starts = [preferences(s, slots) for s in shards]
    at, owner, free = [0] * len(shards), [-1] * slots, slots
    while free:
        for k, (offset, step) in enumerate(starts):
            slot = (offset + at[k] * step) % slots
            while owner[slot] >= 0:
                at[k] += 1
                slot = (offset + at[k] * step) % slots
            owner[slot] = k
            at[k] += 1
            free -= 1
            if not free:
                break
    return np.array(owner, dtype=np.int32)


def table_rows(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """(slot, shard): one row a slot."""
    owner = lookup_table(shards, slots)
    return spark.createDataFrame([(i, shards[k]) for i, k in enumerate(owner.tolist())], "slot int, shard string")


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key: the first 32 bits of the MD5 of its text; a null key counts as the empty text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(slots)).cast("int")


def place(docs: DataFrame, key: str, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """(key, slot, shard) of every row.

    Repeated rows, and rows with equal keys, get the same shard; null keys all
    get the shard of the empty text. An empty table gives an empty result;
    other columns are not looked at.
    """
    keyed = docs.select(F.col(key).alias("key"), slot_of(F.col(key), slots).alias("slot"))
    placed = keyed.join(F.broadcast(table_rows(docs.sparkSession, shards, slots)), "slot")
    return placed.select(F.col("key").alias(key), "slot", "shard")


def write_shards(docs: DataFrame, key: str, shards: list[str], path: str, slots: int = SLOTS, splits: int = 4) -> None:
    """All columns of docs below path/shard=NAME, each shard dealt over `splits` tasks so that none is one task's work.

    A column of docs named shard is replaced by the placement.
    """
    rows = table_rows(docs.sparkSession, shards, slots).select(F.col("slot").alias("__slot"), F.col("shard").alias("__shard"))
    placed = docs.withColumn("__slot", slot_of(F.col(key), slots)).join(F.broadcast(rows), "__slot").drop("__slot")
    placed = placed.drop("shard").withColumnRenamed("__shard", "shard")
    spread = F.pmod(F.xxhash64(*[F.col(c) for c, t in docs.dtypes if c != "shard" and not t.startswith(("map", "variant"))]), F.lit(splits))
    placed.repartition(len(shards) * splits, "shard", spread).write.partitionBy("shard").parquet(path)
