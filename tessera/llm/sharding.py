"""Shard placement by a permutation-filled lookup table.

Every shard has a preference order over the slots of a table of prime size:
slot (offset + j * skip) mod size for j = 0, 1, ... The shards take turns, each
claiming its first slot that is still free, until the table is full. A key is
placed by one lookup: its hash modulo the size gives the slot, the slot gives
the shard. Shards own equal shares (within one slot), and removing a shard
moves few slots between the others.

Defined cases: a null key is placed like the empty string; equal keys always
share a shard; a shard named twice counts once; no shards is an error. An empty
table gives an empty result, and columns of the input other than the key are
ignored (``place``) or kept as they are (``with_shard``), whatever their names.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import unused

#: Prime; over a hundred slots a shard for up to 655 shards, so shares differ by under 1 %.
TABLE_SIZE = 65537
#: The table is sent to every executor; its size is fixed by TABLE_SIZE, never by the data.
MAX_TABLE_SIZE = 1_000_003


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def fill(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """The table: for each slot the position of its shard in shards."""
    if not shards:
        raise ValueError("no shards")
    if size > MAX_TABLE_SIZE or size < 2 or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError("the table size must be a prime up to MAX_TABLE_SIZE")
    if len(shards) > size:
        raise ValueError("more shards than slots")
    start = [_number(f"offset:{s}") % size for s in shards]
    skip = [_number(f"skip:{s}") % (size - 1) + 1 for s in shards]
    at = list(start)
    owner, left = [-1] * size, size
    while left:
        for i in range(len(shards)):
            slot = at[i]
            while owner[slot] >= 0:
                slot = (slot + skip[i]) % size
            owner[slot] = i
            at[i] = (slot + skip[i]) % size
            left -= 1
            if not left:
                break
    return owner


def lookup_table(spark, shards: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """(slot, shard) for every slot, made on the JVM from one string of fixed size."""
    names = list(dict.fromkeys(shards))
    owner = ",".join(map(str, fill(names, size)))
    names_col = F.array(*[F.lit(n) for n in names])
    return spark.range(1).select(F.posexplode(F.split(F.lit(owner), ",")).alias("slot", "position")).select(
        "slot", F.element_at(names_col, F.col("position").cast("int") + 1).alias("shard")
    )


def slot_of(key, size: int = TABLE_SIZE):
    """Slot of a key: 60 bits of its MD5, modulo the size."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(size)).cast("int")


def place(docs: DataFrame, shards: list[str], key: str = "doc_id", size: int = TABLE_SIZE) -> DataFrame:
    """(key, slot, shard), one row per row of docs; no shuffle, one broadcast of fixed size."""
    keyed = docs.select(F.col(key).alias(key), slot_of(F.col(key), size).alias("slot"))
    return keyed.join(F.broadcast(lookup_table(docs.sparkSession, shards, size)), "slot").select(key, "slot", "shard")


def with_shard(docs: DataFrame, shards: list[str], key: str = "doc_id", size: int = TABLE_SIZE, name: str = "shard") -> DataFrame:
    """docs with one more column, the shard (an existing column of that name is replaced)."""
    at, slot, owner = unused(docs, "_at", "_slot", "_owner")
    looked = lookup_table(docs.sparkSession, shards, size).toDF(slot, owner)
    out = docs.drop(name) if name != key else docs
    return (
        out.withColumn(at, slot_of(F.col(key), size))
        .join(F.broadcast(looked), F.col(at) == F.col(slot))
        .withColumn(name, F.col(owner))
        .drop(at, slot, owner)
    )


def write_shards(docs: DataFrame, path: str, shards: list[str], key: str = "doc_id", size: int = TABLE_SIZE) -> None:
    """Write docs under path/shard=NAME/. Rows are spread over tasks as they come, so no shard is one task."""
    with_shard(docs, shards, key, size).write.partitionBy("shard").parquet(path)
