"""Placement on shards by a permutation-filled lookup table, on the JVM only.

Every shard has a preference order over the slots of a table of prime size, given by an offset and a step
from the md5 of its name. Shards take turns and claim their next free slot until the table is full. A row
goes to the shard that holds the slot of its key's md5. Shards get equal numbers of slots up to one, and
when a shard is added or removed few slots change hands.

The filled table has ``size`` rows whatever the data, so it is broadcast, and placement is one map-side
join: constant time per row, no shuffle, and a hot key costs nothing.

Defined results: a null key has the hash of the empty string; equal keys go to equal shards; other columns are
kept, those named ``slot`` or ``shard`` replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE = 65_537  # prime, a few hundred times the number of shards


def _half(name: str, part: int) -> int:
    return int(hashlib.md5(name.encode()).hexdigest()[16 * part : 16 * part + 15], 16)


def lookup_table(shards: list[str], size: int = SIZE) -> list[int]:
    """Index of the shard for every slot."""
    if not shards:
        raise ValueError("no shards")
    names = sorted(set(shards))
    if len(names) > size or any(size % n == 0 for n in range(2, int(size**0.5) + 1)):
        raise ValueError("the size must be a prime and not below the number of shards")
    place = {n: shards.index(n) for n in names}
    at = [_half(n, 0) % size for n in names]
    step = [_half(n, 1) % (size - 1) + 1 for n in names]
    slots, free = [-1] * size, size
    while free:
        for i, name in enumerate(names):
            while slots[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % size
            slots[at[i]] = place[name]
            free -= 1
            if not free:
                break
    return slots


def slot_of(key: Column, size: int = SIZE) -> Column:
    text = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return F.pmod(F.conv(F.substring(text, 1, 15), 16, 10).cast("bigint"), F.lit(size))


def place(rows: DataFrame, key_col: str, shards: list[str], size: int = SIZE) -> DataFrame:
    """``rows`` plus ``slot`` and ``shard``."""
    filled = ",".join(map(str, lookup_table(shards, size)))
    names = F.array(*map(F.lit, shards))
    table = rows.sparkSession.range(1, numPartitions=1).select(F.posexplode(F.split(F.lit(filled), ",")).alias("slot", "_index"))
    table = table.select(F.col("slot").cast("bigint"), F.element_at(names, F.col("_index").cast("int") + 1).alias("shard"))
    return rows.drop("shard").withColumn("slot", slot_of(F.col(key_col), size)).join(F.broadcast(table), "slot", "left")


def place_sql(table: str, key_col: str, shards: list[str], size: int = SIZE) -> str:
    """The same placement as DuckDB SQL over the filled table."""
    filled = ",".join(map(str, lookup_table(shards, size)))
    names = ", ".join(f"'{s}'" for s in shards)
    hashed = f"('0x' || substr(md5(coalesce({key_col}::VARCHAR, '')), 1, 15))::BIGINT"
    return (
        f"WITH filled AS (SELECT string_split('{filled}', ',')::INT[] AS t), names AS (SELECT [{names}] AS n) "
        f"SELECT {key_col}, {hashed} % {size} AS slot, n[t[({hashed} % {size}) + 1] + 1] AS shard FROM {table}, filled, names"
    )
