"""Sharding by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a table of prime
size.  The shards take turns; at its turn a shard claims the first slot in its
order that is still free.  All shards end with the same number of slots, one at
most apart, and when a shard is added or lost few slots change hands.  A row is
placed by one hash and one look-up in the broadcast table.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns

#: The table is broadcast, so its size is bounded: 12 bytes a slot.
MAX_SLOTS = 4_000_037


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def preference(shard: str, slots: int) -> tuple[int, int]:
    """Where a shard's order of preference starts, and its step; as ``slots`` is prime, the steps visit every slot once."""
    digest = hashlib.sha256(shard.encode()).digest()
    return int.from_bytes(digest[:8], "big") % slots, int.from_bytes(digest[8:16], "big") % (slots - 1) + 1 if slots > 2 else 1


def lookup_table(shards: list[str], slots: int = 65_537) -> list[int]:
    """For each slot, the position in ``shards`` of the shard that claimed it."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be named, and no two alike")
    if not is_prime(slots) or not len(shards) <= slots <= MAX_SLOTS:
        raise ValueError(f"slots must be a prime from the number of shards to {MAX_SLOTS}")
    orders = [preference(s, slots) for s in shards]
    owner, step, left = [-1] * slots, [0] * len(shards), slots
    while left:
        for i, (start, skip) in enumerate(orders):
            slot = (start + step[i] * skip) % slots
            while owner[slot] >= 0:
                step[i] += 1
                slot = (start + step[i] * skip) % slots
            owner[slot] = i
            step[i] += 1
            left -= 1
            if not left:
                break
    return owner


def table_frame(spark: SparkSession, shards: list[str], slots: int = 65_537) -> DataFrame:
    owner = lookup_table(shards, slots)
    return spark.createDataFrame([(k, i, shards[i]) for k, i in enumerate(owner)], "slot int, shard int, shard_name string")


def place(docs: DataFrame, shards: list[str], slots: int = 65_537, key: str = "doc_id") -> DataFrame:
    """``docs`` with slot, shard and shard_name (columns of those names are replaced).

    Rows of one key share a shard; a null key has a slot like any other value.
    No row moves: the table is broadcast and its size is bounded by MAX_SLOTS."""
    own = [c for name, c in zip(docs.columns, columns(docs), strict=True) if name.lower() not in ("slot", "shard", "shard_name")]
    (named,) = [c for name, c in zip(docs.columns, columns(docs), strict=True) if name == key]
    slot = F.pmod(F.xxhash64(named.cast("string")), F.lit(slots)).cast("int").alias("slot")
    return docs.select(*own, slot).join(F.broadcast(table_frame(docs.sparkSession, shards, slots)), "slot").select(*own, "slot", "shard", "shard_name")


def write_shards(docs: DataFrame, path: str, shards: list[str], slots: int = 65_537, key: str = "doc_id", files: int = 1) -> None:
    """One folder per shard, of ``files`` files each: a shard of any size is written by several tasks."""
    placed = place(docs, shards, slots, key).withColumn("piece", F.pmod(F.col("slot"), F.lit(files)))
    placed.repartition(len(shards) * files, "shard", "piece").drop("piece").write.partitionBy("shard").parquet(path)
