"""Place rows on shards through a permutation-filled lookup table.

The table has a prime number of slots. Each shard prefers the slots in an order of its own (a start and
a step, both from a digest of its name), and the shards take turns: each claims the first slot in its
order that is still free. Every shard so owns as many slots as any other, give or take one, and taking
a shard away moves little beyond its own rows. The table is a few kilobytes whatever the input, hence
the broadcast; a row costs one digest and one look-up.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slots: a prime, well over a hundred for each shard, so that shares differ by less than one in a hundred.
SLOTS, SHARDS = 16_381, 64


def preference(name: str, slots: int) -> tuple[int, int]:
    """Start and step of a shard's order of slots; as slots is prime, any step visits all."""
    digest = hashlib.md5(name.encode()).hexdigest()
    return int(digest[:8], 16) % slots, 1 + int(digest[8:16], 16) % (slots - 1)


def fill_table(names: list[str], slots: int = SLOTS) -> list[int]:
    """Slot to index of the shard that has claimed it."""
    if not names:
        raise ValueError("no shards")
    if slots < len(names) or slots < 2 or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime and no fewer than the shards")
    orders = [preference(n, slots) for n in names]
    tried, table, free = [0] * len(names), [-1] * slots, slots
    while free:
        for shard, (start, step) in enumerate(orders):
            slot = (start + tried[shard] * step) % slots
            while table[slot] >= 0:
                tried[shard] += 1
                slot = (start + tried[shard] * step) % slots
            table[slot] = shard
            tried[shard] += 1
            free -= 1
            if not free:
                break
    return table


def slot_of(key: Column, slots: int) -> Column:
    """The first 32 bits of the MD5 of the key as text, modulo slots. A null key has slot 0."""
    return F.coalesce(F.pmod(F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(slots)), F.lit(0).cast("long"))


def shard(df: DataFrame, key: str, names: list[str] | None = None, slots: int = SLOTS) -> DataFrame:
    """The rows with ``slot`` and ``shard``.

    Rows with the same key go to the same shard; a null key to that of slot 0. Repeated rows stay, an
    empty table stays empty. The two new columns replace columns of those names.
    """
    names = names or [f"shard-{i}" for i in range(SHARDS)]
    session = df.sparkSession
    table = F.from_json(F.lit(str(fill_table(names, slots))), "array<int>")
    lookup = session.range(1).select(F.posexplode(table).alias("__slot", "shard")).select(F.col("__slot").cast("long"), F.col("shard").cast("long"))
    rows = df.drop("slot", "shard").withColumn("slot", slot_of(F.col(key), slots))
    return rows.join(F.broadcast(lookup), F.col("slot") == F.col("__slot"), "left").drop("__slot")


def write_shards(df: DataFrame, key: str, path: str, names: list[str] | None = None, slots: int = SLOTS, files: int = 8) -> None:
    """Each shard's rows in a folder of its own, in ``files`` files, so that one repeated key doesn't make one task of a third of the rows."""
    placed = shard(df, key, names, slots)
    placed.repartition(len(names or range(SHARDS)) * files, "shard", F.pmod(F.xxhash64(*df.columns), F.lit(files))).write.mode("overwrite").partitionBy("shard").parquet(path)


def oracle(slots: int = SLOTS, shards: int = SHARDS) -> str:
    table = fill_table([f"shard-{i}" for i in range(shards)], slots)
    return f"""
    WITH placed AS (
      SELECT doc_id, coalesce(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT % {slots}, 0) AS slot FROM documents
    )
    SELECT doc_id, slot, CAST(({table})[CAST(slot AS INTEGER) + 1] AS BIGINT) AS shard FROM placed
    """
