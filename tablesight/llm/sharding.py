"""Shard placement by a permutation-filled lookup table.

Each shard has its own permutation of the slots of a table of prime size (an
offset and a step, both from a hash of the shard's name). The shards take
turns, each claiming the first free slot of its permutation, until the table
is full. So shards own equal numbers of slots within one, and when a shard
goes, few slots move between the others. Documents look up the slot that a
hash of their key gives: constant time, without a shuffle. Writing the shards
shuffles each row once.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Prime; at least 100 slots per shard keep loads within about 1 %.
TABLE_SIZE = 65537
MAX_SHARDS = TABLE_SIZE // 100


def lookup_table(shards: list[str], size: int = TABLE_SIZE) -> np.ndarray:
    """Slot -> index of the shard in ``shards``. Names must differ. Ties in
    turn order are resolved by the order of names, so the table doesn't
    depend on the order of the list."""
    if len(set(shards)) != len(shards) or not shards:
        raise ValueError("shards: at least one name, all different")
    if len(shards) > size // 100:
        raise ValueError(f"{len(shards)} shards need a larger prime table than {size}")
    if any(size % d == 0 for d in range(2, int(size ** 0.5) + 1)):
        raise ValueError(f"the table size {size} is not prime")
    order = sorted(range(len(shards)), key=lambda i: shards[i])
    place, step = {}, {}
    for i in order:
        digest = hashlib.sha256(shards[i].encode()).digest()
        place[i] = int.from_bytes(digest[:8], "big") % size
        step[i] = int.from_bytes(digest[8:16], "big") % (size - 1) + 1
    table = np.full(size, -1, np.int32)
    filled = 0
    while True:
        for i in order:
            while table[place[i]] >= 0:
                place[i] = (place[i] + step[i]) % size
            table[place[i]] = i
            filled += 1
            if filled == size:
                return table


def place(df: DataFrame, shards: list[str], key: str = "doc_id", size: int = TABLE_SIZE,
          slot_col: str = "slot", shard_col: str = "shard") -> DataFrame:
    """``df`` with ``slot_col`` (long) and ``shard_col`` (string).

    The slot is a hash of the key as text, modulo the table size; a null key
    counts as the text "null:" and repeated keys share a shard. Columns of
    ``df`` by these two names, in any case, are replaced; give other names to
    keep them. The table of ``size`` slots (a fixed bound, under 2 MB) is
    broadcast.
    """
    table = lookup_table(shards, size)
    slots = df.sparkSession.createDataFrame(pa.table({slot_col: np.arange(size), shard_col: np.array(shards, object)[table]}))
    text = F.coalesce(F.concat(F.lit("key:"), F.col(f"`{key}`").cast("string")), F.lit("null:"))
    slot = F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), F.lit(size))
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in (slot_col.lower(), shard_col.lower())]
    placed = df.select(*kept, slot.alias(slot_col))
    return placed.join(F.broadcast(slots), slot_col).select(*kept, f"`{slot_col}`", f"`{shard_col}`")


def write_shards(df: DataFrame, path: str, shards: list[str], key: str = "doc_id", size: int = TABLE_SIZE,
                 slot_col: str = "slot", shard_col: str = "shard") -> DataFrame:
    """Write the whole rows of ``df`` as Parquet, one folder per shard, and
    return what the files hold: the columns of ``df``, slot and shard, as by
    ``place``. Shards without rows have no folder; an empty table writes none
    and returns no rows.

    Rows are rebalanced by shard: adaptive execution merges small shards into
    a task and splits a large one, such as that of a hot key, by the advisory
    partition size, so tasks and files follow the data and no task takes a
    whole shard. Rows go by a hash of the shard's name alone, so a task that
    is run again after a lost executor writes the same rows.
    """
    placed = place(df, shards, key, size, slot_col, shard_col)
    placed.hint("rebalance", F.col(f"`{shard_col}`")).write.partitionBy(shard_col).parquet(path)
    # The schema is given, so that shard names made of digits stay text.
    return df.sparkSession.read.schema(placed.schema).parquet(path).select(*(F.col(f"`{c}`") for c in placed.columns))
