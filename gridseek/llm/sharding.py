"""Placement of documents on shards by a permutation-filled lookup table.

Each shard has its own order of preference over the slots of a prime-sized table: an offset and a step,
both from a hash of its name. The shards take turns; at its turn a shard claims the first slot of its
order that is still free (a shard of weight w has w turns a round). All shares come out nearly equal, and
when a shard joins or leaves most slots keep their shard. The table has a fixed number of slots whatever
the data, so it is broadcast, and a document's place is one look-up of its id's hash.

Cases: null ids share the slot of the empty key; equal ids share a shard; other columns don't matter; an
empty table places nothing. DataFrame operations only.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A prime well over 100 times the shards, so that shares differ by under 1 %.
SLOTS = 65_537
SHARDS = 48


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(names: list[str], slots: int = SLOTS, weights: list[int] | None = None) -> list[int]:
    """The shard (an index into names) of each slot."""
    if not names or len(set(names)) < len(names) or slots < 2 or any(slots % p == 0 for p in range(2, int(slots**0.5) + 1)):
        raise ValueError("needs distinct shard names and a prime number of slots")
    steps = [(_number(f"{n}/offset") % slots, _number(f"{n}/skip") % (slots - 1) + 1) for n in names]
    turns = weights or [1] * len(names)
    if len(turns) != len(names) or min(turns) < 0 or not sum(turns):
        raise ValueError("needs a weight for each shard, one above 0 at least")
    table, at, free = [-1] * slots, [o for o, _ in steps], slots
    while free:
        for shard, (_, skip) in enumerate(steps):
            for _ in range(turns[shard]):
                if not free:
                    break
                slot = at[shard]
                while table[slot] >= 0:
                    slot = (slot + skip) % slots
                table[slot], at[shard], free = shard, (slot + skip) % slots, free - 1
    return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long") % slots


def table_frame(spark: SparkSession, table: list[int]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(table)), T.StructType([T.StructField("slot", T.LongType()), T.StructField("shard", T.LongType())]))


def place(docs: DataFrame, table: list[int], id_col: str = "doc_id") -> DataFrame:
    """Each row's id with its slot and shard."""
    placed = docs.select(docs[id_col].alias("id"), slot_of(docs[id_col], len(table)).alias("slot"))
    return placed.join(F.broadcast(table_frame(docs.sparkSession, table)), "slot").select(F.col("id").alias(id_col), "slot", "shard")


def write_shards(docs: DataFrame, table: list[int], path: str, id_col: str = "doc_id", files: int = 1) -> None:
    """Write each shard to its own folder, in `files` files; rows are dealt by a hash of the whole row within a shard."""
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    at = plain[f"c{names.index(id_col)}"]
    marked = plain.withColumn("slot", slot_of(at, len(table))).join(F.broadcast(table_frame(docs.sparkSession, table)), "slot").drop("slot")
    dealt = marked.withColumn("file", F.pmod(F.xxhash64(*plain.columns), F.lit(files))).repartition("shard", "file").drop("file")
    dealt.toDF(*names, "shard").write.mode("overwrite").partitionBy("shard").parquet(path)
