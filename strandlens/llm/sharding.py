"""Sharding by a permutation-filled lookup table.

Every shard has a preference order over the slots of a prime-sized table, given by an offset and a skip
that come from its name. The shards take turns; each claims its first free slot. Every shard so gets an equal
share (within one slot), and most slots keep their shard when shards come or go. A row finds its
shard by one look at a broadcast table whose size is a parameter, not a function of the data."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import fresh

SLOTS = 6553  # a prime, about 100 slots for each of 64 shards
MAX_SLOTS = 1 << 22  # what may be broadcast: 4 million pairs of integers


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The shard (by its place in ``shards``) of each slot. Names must differ; more shards than slots, a
    size that isn't prime, or one over MAX_SLOTS is an error."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need different names, one at least")
    if not _is_prime(slots) or not len(shards) <= slots <= MAX_SLOTS:
        raise ValueError(f"slots must be a prime from {len(shards)} to {MAX_SLOTS}")
    at = [_number(f"{s}/offset") % slots for s in shards]
    skip = [_number(f"{s}/skip") % (slots - 1) + 1 for s in shards]
    table, free = [-1] * slots, slots
    while free:
        for i in range(len(shards)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % slots
            table[at[i]] = i
            free -= 1
            if not free:
                break
    return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key: its text's MD5, so every engine and every run agrees. A null key has a slot of its own."""
    digest = F.md5(F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.lit("null")))
    return (F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % slots).cast("int")


def shard(rows: DataFrame, key: str, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """``rows`` with ``slot`` int, ``shard`` int and ``shard_name`` string (columns of these names, in any case, are replaced; the key may be one of
    them).

    Rows with equal keys meet in one shard. Null keys share a slot, empty tables stay empty, repeated rows stay
    repeated. Nothing is shuffled: a key that holds a third of all rows costs its shard room, not this step."""
    listed = F.split(F.lit(",".join(map(str, fill(shards, slots)))), ",")
    names = F.split(F.lit("\n".join(shards)), "\n")
    slot, number, name = fresh(rows, "slot", "shard", "shard_name")
    table = rows.sparkSession.range(slots).select(
        F.col("id").cast("int").alias(slot),
        F.element_at(listed, F.col("id").cast("int") + 1).cast("int").alias(number),
    )
    table = table.withColumn(name, F.element_at(names, F.col(number) + 1))
    placed = rows.withColumn(slot, slot_of(F.col(f"`{key}`"), slots)).join(F.broadcast(table), slot)
    # Spark takes names that differ by case only for one, so such a column is replaced, too.
    columns = [F.col(f"`{c}`") for c in rows.columns if c.lower() not in ("slot", "shard", "shard_name")]
    return placed.select(*columns, F.col(slot).alias("slot"), F.col(number).alias("shard"), F.col(name).alias("shard_name"))
