"""Sharding by a permutation-filled lookup table (DataFrame functions only).

Every shard has its own order of the slots of a table of prime size. The shards take
turns; each claims the first slot of its order that is still free, until none is left.
So slots are shared out evenly, and few change hands when a shard comes or goes. A row's
slot is a hash of its key modulo the size; the table is broadcast, and its size is a
parameter that does not grow with the data.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_TABLE_SIZE = 2_000_003


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def fill_table(shards: list[str], size: int = 65_537) -> list[int]:
    """The position in ``shards`` of the owner of each slot.

    A shard's order of slots starts at an offset and goes on in steps, both hashed from
    its name; ``size`` is prime, so each step visits every slot.
    """
    if size > MAX_TABLE_SIZE or size < 2 or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError(f"the table size must be a prime of at most {MAX_TABLE_SIZE}: {size}")
    if not 1 <= len(set(shards)) == len(shards) <= size:
        raise ValueError("shards must be one or more different names, no more than slots")
    at = [_number(f"{s}|offset") % size for s in shards]
    step = [_number(f"{s}|step") % (size - 1) + 1 for s in shards]
    table, free = [-1] * size, size
    while True:
        for i in range(len(shards)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % size
            table[at[i]] = i
            free -= 1
            if not free:
                return table


def slot_of(size: int, *key_cols: str):
    """The slot of a row; null keys count as empty."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key_cols])
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), F.lit(size)).cast("int")


def table_frame(spark: SparkSession, table: list[int], shards: list[str]) -> DataFrame:
    """``slot, shard`` as a table of one literal."""
    owners = F.split(F.lit(",".join(map(str, table))), ",")
    names = F.split(F.lit("\x00".join(shards)), "\x00")
    return spark.range(1).select(F.posexplode(owners).alias("slot", "owner")).select(
        "slot", F.element_at(names, F.col("owner").cast("int") + 1).alias("shard")
    )


def assign_shards(docs: DataFrame, shards: list[str], key_cols: tuple[str, ...] = ("doc_id",), size: int = 65_537) -> DataFrame:
    """``docs`` with ``slot`` and ``shard``; columns of that name are replaced.

    Rows of equal keys go to one shard, rows with null keys too. No row moves: placement
    is a broadcast lookup, and ``write.partitionBy('shard')`` may follow. Of a key with
    very many rows, name more columns to spread it. Other columns, null and long texts are kept as they are; repeated rows share a shard. No rows in, no rows out.
    """
    placed = docs.drop("shard").withColumn("slot", slot_of(size, *key_cols))
    lookup = table_frame(docs.sparkSession, fill_table(shards, size), shards)
    return placed.join(F.broadcast(lookup), "slot").select(*[c for c in placed.columns if c != "slot"], "slot", "shard")
