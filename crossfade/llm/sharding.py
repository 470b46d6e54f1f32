"""Sharding by a lookup table that shards fill in turns.

Each shard has a permutation of the table's slots, from two hashes of its name;
shards take turns claiming the first slot of theirs that is still free. The
table's size is prime, so every step size gives a permutation, and far larger
than the number of shards, so they get nearly equal shares. When shards come or
go, few other slots change hands.

The table is the only thing that is broadcast: at most ``MOST_SLOTS`` rows of
two numbers. Placing a row is one hash and one lookup, without a shuffle,
whatever the distribution of keys.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_SLOTS = 1 << 20
_DIGITS = 15  # hexadecimal ones of a hash: below 2 ** 60


def _hash(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:_DIGITS], 16)


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def preference(shard: str, slots: int) -> tuple[int, int]:
    """First slot and step of a shard's permutation."""
    return _hash(f"{shard}/first") % slots, _hash(f"{shard}/step") % (slots - 1) + 1


def lookup_table(shards: list[str], slots: int) -> list[int]:
    """The position in ``shards`` of the owner of each slot."""
    if len(set(shards)) != len(shards) or not shards:
        raise ValueError("shards need names, each its own")
    if not is_prime(slots) or not len(shards) <= slots <= MOST_SLOTS:
        raise ValueError(f"slots must be a prime, no fewer than the shards and at most {MOST_SLOTS}")
    walks = [preference(s, slots) for s in shards]
    owner, at, free = [-1] * slots, [first for first, _ in walks], slots
    while free:
        for shard, (_, step) in enumerate(walks):
            while owner[at[shard]] >= 0:
                at[shard] = (at[shard] + step) % slots
            owner[at[shard]] = shard
            free -= 1
            if not free:
                break
    return owner


def slot_of(key: Column, slots: int) -> Column:
    """The slot of a key, from the hash of its text."""
    return (F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, _DIGITS), 16, 10).cast("bigint") % slots).cast("int")


def place(docs: DataFrame, shards: list[str], slots: int = 65_537, key_col: str = "doc_id") -> DataFrame:
    """``docs`` with ``slot`` and ``shard``; columns of these names are replaced.

    Equal keys go to one shard. Rows with a NULL key are spread by the hash of
    their other columns. Every row is kept, repeats included.
    """
    columns = [c for c in docs.columns if c not in ("slot", "shard")]
    others = F.xxhash64(*(F.col(c) for c in columns))
    rows = docs.select(*columns, slot_of(F.coalesce(F.col(key_col).cast("string"), others.cast("string")), slots).alias("slot"))
    owners = [(slot, shards[i]) for slot, i in enumerate(lookup_table(shards, slots))]
    table = docs.sparkSession.createDataFrame(owners, "__slot int, shard string")
    return rows.join(F.broadcast(table), F.col("slot") == F.col("__slot")).select(*columns, "slot", "shard")


def write(placed: DataFrame, path: str) -> None:
    """Parquet with a folder per shard; rows are rebalanced, so no shard waits for one task."""
    placed.hint("rebalance", "shard").write.partitionBy("shard").parquet(path)
