"""Sharding by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a prime-sized table. The shards take turns: each claims
the first slot of its order that is still free, until the table is full. A row goes to the shard that owns the slot
its key hashes to. Shards own nearly equal numbers of slots, and adding or removing one moves few rows besides those
that must move. The table is the only thing broadcast; its size is a parameter with a checked bound, so it does not
depend on the data, and placing a row takes one lookup and no shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import own_names, table

#: The largest lookup table that is broadcast: about 12 MB of slot and shard numbers.
MAX_SLOTS = 1_000_003


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(shards: Sequence[str], slots: int = 65_537) -> np.ndarray:
    """The owner (an index into ``shards``) of each slot. ``slots`` is prime, so any stride visits every slot."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct and at least one")
    if not _is_prime(slots) or slots < len(shards) or slots > MAX_SLOTS:
        raise ValueError(f"slots must be a prime from the number of shards to {MAX_SLOTS}")
    digests = [hashlib.md5(name.encode()).digest() for name in shards]
    first = [int.from_bytes(d[:8], "little") % slots for d in digests]
    stride = [int.from_bytes(d[8:], "little") % (slots - 1) + 1 for d in digests]
    # Each shard's whole order of preference as one cursor into a virtual permutation.
    owner = np.full(slots, -1, dtype=np.int32)
    position = list(first)
    free = slots
    while free:
        for shard in range(len(shards)):
            slot = position[shard]
            while owner[slot] >= 0:
                slot = (slot + stride[shard]) % slots
            owner[slot] = shard
            position[shard] = (slot + stride[shard]) % slots
            free -= 1
            if not free:
                break
    return owner


def place(df: DataFrame, key: str, shards: Sequence[str], slots: int = 65_537, slot_name: str = "slot", shard_name: str = "shard") -> DataFrame:
    """``df`` with the slot and the shard of each row; columns of these names are replaced.

    The key is hashed as text. Null keys hash as the empty text, so they share one shard; rows with equal keys
    always share a shard; an empty table gives an empty table.
    """
    owner = lookup_table(shards, slots)
    spark = df.sparkSession
    name = own_names(df)
    slots_df = spark.createDataFrame(pa.table({name("slot"): np.arange(slots, dtype=np.int32), name("owner"): owner}))
    names = F.array(*[F.lit(s) for s in shards])
    keyed = df.drop(slot_name, shard_name) if key not in (slot_name, shard_name) else df
    keyed = keyed.withColumn(name("key"), F.pmod(F.xxhash64(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))), F.lit(slots)).cast("int"))
    placed = keyed.join(F.broadcast(slots_df), F.col(name("key")) == F.col(name("slot")))
    return placed.withColumn(slot_name, F.col(name("slot"))).withColumn(shard_name, F.element_at(names, F.col(name("owner")) + 1)).drop(name("key"), name("slot"), name("owner"))


def write_shards(placed: DataFrame, path: str, shard_name: str = "shard", files_per_shard: int = 8) -> None:
    """One folder a shard. The rows of a shard are dealt to several writers, so a large shard is no single task."""
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(files_per_shard))
    name = own_names(placed)("salt")
    placed.withColumn(name, salt).repartition(F.col(shard_name), F.col(name)).drop(name).write.partitionBy(shard_name).parquet(path)


def shard_names(n: int) -> list[str]:
    return [f"shard-{i:04d}" for i in range(n)]


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard among 64."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    return place(docs, "doc_id", shard_names(64))


QUERIES: dict[str, Callable] = {"op4_sharding": op4_sharding}
SQL: dict[str, str] = {}
