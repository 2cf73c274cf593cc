"""Shards by a permutation-filled lookup table.

Each shard has its own permutation of the slots of a prime-sized table
(offset + j * skip), and shards take turns claiming the first slot of theirs
that is still free. A row's key hashes to a slot, so placing it is one lookup in
a broadcast table of fixed size. When a shard joins or leaves, few slots change.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import free_name

MAX_TABLE = 1_000_003


def table_size(n_shards: int, slots_per_shard: int = 100) -> int:
    """The least prime with that many slots for each shard."""
    n = max(n_shards * slots_per_shard, 2)
    while any(n % d == 0 for d in range(2, int(n ** 0.5) + 1)):
        n += 1
    return n


def preference(shard: str, size: int) -> tuple[int, int]:
    """(offset, skip) of a shard's permutation, from the md5 of its name."""
    digest = hashlib.md5(shard.encode()).hexdigest()
    return int(digest[:15], 16) % size, int(digest[15:30], 16) % (size - 1) + 1


def fill_table(shards: list[str], size: int | None = None) -> list[int]:
    """The shard's index for each slot; shards claim in the order given, one slot a turn."""
    size = size or table_size(len(shards))
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shard names must be distinct, and at least one")
    if not len(shards) <= size <= MAX_TABLE:
        raise ValueError(f"the table needs a slot for each shard, {MAX_TABLE} at most")
    if any(size % d == 0 for d in range(2, int(size ** 0.5) + 1)):
        raise ValueError("the table's size must be prime")
    table, left = [-1] * size, size
    slots = [preference(s, size) for s in shards]
    at = [offset for offset, _ in slots]
    while left:
        for i, (_, skip) in enumerate(slots):
            if not left:
                break
            while table[at[i]] >= 0:
                at[i] = (at[i] + skip) % size
            table[at[i]] = i
            left -= 1
    return table


def key_slot(key: Column, size: int) -> Column:
    """A key's slot: the first 60 bits of its text's md5, modulo the table's size; a null key counts as empty."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % size


def place(df: DataFrame, key: str, shards: list[str], size: int | None = None,
          slot_col: str = "slot", shard_col: str = "shard") -> DataFrame:
    """Adds a row's slot and shard name; they replace columns of these names.

    All rows of a key land in one shard (a null key as the empty text, repeated
    rows together). The lookup table has ``size`` rows, at most ``MAX_TABLE``,
    and is broadcast; rows are not shuffled.
    """
    table = fill_table(shards, size)
    text = F.concat_ws(",", F.lit(",".join(map(str, table))))
    names = F.array(*[F.lit(s) for s in shards])
    slot, shard = free_name(df, "_slot"), free_name(df, "_shard")
    lookup = (df.sparkSession.range(1, numPartitions=1).select(F.posexplode(F.split(text, ",")).alias("at", "i"))
              .select(F.col("at").cast("long").alias(slot), F.get(names, F.col("i").cast("int")).alias(shard)))
    kept = [c for c in df.columns if c.lower() not in (slot_col.lower(), shard_col.lower())]
    out = df.withColumn(slot, key_slot(F.col(key), len(table))).select(*kept, slot)
    return out.join(F.broadcast(lookup), slot).select(*kept, F.col(slot).alias(slot_col), F.col(shard).alias(shard_col))


def sharding_sql(shards: list[str], size: int, source: str = "documents", key: str = "doc_id") -> str:
    """DuckDB SQL of ``place``: turns are a recursion whose state is the list of free slots.

    A shard's turn takes the free slot that stands first in its permutation:
    the least ((slot - offset) * inverse of skip) mod size.
    """
    prefs = [preference(s, size) for s in shards]
    rows = ", ".join(f"({i}, '{s}', {off}, {pow(skip, -1, size)})" for i, (s, (off, skip)) in enumerate(zip(shards, prefs)))
    return f"""
WITH RECURSIVE pref(i, name, off, inv) AS (VALUES {rows}),
turns(turn, slot, free) AS (
  SELECT -1, -1, range({size})
  UNION ALL
  SELECT turn + 1, pick, list_filter(free, lambda x: x <> pick)
  FROM (SELECT turn, free,
          list_aggregate(list_transform(free, lambda x: (((x - off + {size}) * inv) % {size}) * {size} + x), 'min') % {size} AS pick
        FROM turns JOIN pref ON pref.i = (turn + 1) % {len(shards)}
        WHERE len(free) > 0)
)
SELECT d.{key}, t.slot, p.name AS shard
FROM {source} d
JOIN turns t ON t.slot = ('0x' || substr(md5(coalesce(CAST(d.{key} AS VARCHAR), '')), 1, 15))::BIGINT % {size} AND t.turn >= 0
JOIN pref p ON p.i = t.turn % {len(shards)}
"""
