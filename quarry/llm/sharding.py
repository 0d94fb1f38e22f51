"""Sharding by a permutation-filled lookup table: constant-time placement that moves few keys when shards change."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slots of the table, a prime; about a hundred times the shards or more keeps shares within a percent.
SLOTS = 65_537
#: Slots at most: the table is broadcast, some 16 bytes a slot and the shards' names.
MOST_SLOTS = 1 << 22


def _number(text: str) -> int:
    return int.from_bytes(hashlib.md5(text.encode()).digest()[:8], "big")


def fill(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The shard of each slot: shards take turns, each claiming the next free slot of its own permutation of all slots.

    A permutation is an offset and a step, both from hashes of the shard's name; it reaches every slot as their number
    is prime. Shares differ by one slot at most. Shards with equal names would want the same slots, so names must differ.
    """
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards need names, each its own")
    if slots > MOST_SLOTS:
        raise ValueError(f"a table of more than {MOST_SLOTS} slots is too large to broadcast")
    if slots < len(shards) or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime and at least as many as shards")
    at = [_number(f"offset|{s}") % slots for s in shards]
    step = [_number(f"step|{s}") % (slots - 1) + 1 if slots > 2 else 1 for s in shards]
    table, left = [-1] * slots, slots
    while True:
        for k in range(len(shards)):
            while table[at[k]] >= 0:
                at[k] = (at[k] + step[k]) % slots
            table[at[k]] = k
            left -= 1
            if not left:
                return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key: 60 bits of the MD5 of its text, modulo slots; a null key counts as empty."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def place(docs: DataFrame, shards: list[str], key_col: str = "doc_id", slots: int = SLOTS, slot_name: str = "slot", shard_name: str = "shard") -> DataFrame:
    """docs with the slot and shard of each row's key. No shuffle: the table has `slots` rows whatever the data are.

    Rows with equal keys share a shard, so repeated rows stay together; a key column with few values puts each value
    on one shard, so shard by an id. A null key counts as an empty one; texts, null or long, are passed on unread; an empty
    table gives an empty one. slot_name and shard_name replace columns of docs that have these names; other names are free
    but for _q_at, _q_slot and _q_shard.
    """
    table = docs.sparkSession.createDataFrame(list(enumerate(shards[k] for k in fill(shards, slots))), "_q_slot int, _q_shard string")
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in (slot_name, shard_name)]
    keyed = docs.select("*", slot_of(F.col(f"`{key_col}`"), slots).alias("_q_at"))
    joined = keyed.join(F.broadcast(table), F.col("_q_at") == F.col("_q_slot"))
    return joined.select(*kept, F.col("_q_slot").alias(slot_name), F.col("_q_shard").alias(shard_name))


def write_shards(placed: DataFrame, path: str, shard_col: str = "shard", rows_per_file: int = 1_000_000) -> None:
    """One folder for each shard, in files of at most rows_per_file rows; rows are balanced over tasks, hot shards split."""
    placed.hint("rebalance", shard_col).write.option("maxRecordsPerFile", rows_per_file).partitionBy(shard_col).parquet(path)
