"""Weighted rendezvous hashing of stable record keys over shards.

Every shard draws a uniform number from the hash of (key, shard) and turns it into an
exponential waiting time with the shard's weight as its rate; the shard with the shortest time
takes the record. A shard's draws do not depend on the other shards, so adding a shard moves only
the records that the new one wins, and removing one moves only its own.

Rows are placed by a projection: no shuffle, and no shard is ever gathered in one task. The slot
of a row inside its shard is its rank in hash order. Ranks are counted in two levels: rows are
split by (shard, hash range), the ranges' counts are summed up, and only rows of one range are
ranked together.

Edge cases: a null key hashes like any other value, so all null keys share a shard; a null or
empty text has 0 bytes and crc32 0; equal keys always share a shard; repeated rows get slots of
their own; an empty table gives an empty result; extra columns of any name are ignored by
`placements` and kept by `assign` (a clash with its output column is an overwrite).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from settlekit.llm.common import hash_bits, hash_range, stable

#: Rows of one hash range inside a shard, as aimed at.
RANGE_ROWS = 50_000


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (0 to len(weights) - 1) of `key`; weights are positive."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive, one for each shard")

    def wait(shard: int, weight: float) -> Column:
        # 52 bits of the hash, moved off 0 and 1, as a uniform number
        bits = hash_bits(F.md5(F.concat(stable(key), F.lit(f":{shard}"))), 13)
        return -F.log((bits + 0.5) / F.lit(float(1 << 52))) / F.lit(float(weight))

    draws = [F.struct(wait(i, w).alias("wait"), F.lit(i).alias("shard")) for i, w in enumerate(weights)]
    return (F.least(*draws) if len(draws) > 1 else draws[0])["shard"]


def assign(df: DataFrame, key: str, weights: Sequence[float], into: str = "shard") -> DataFrame:
    """`df` with the shard of each row; an existing column `into` is overwritten."""
    return df.withColumn(into, rendezvous(F.col(key), weights))


def with_slots(df: DataFrame, shard: str, key: str, ties: Sequence[str], rows: int) -> DataFrame:
    """Adds `slot`: 0, 1, ... inside each shard, in order of the key's hash, then `ties`.

    `rows` is the number of rows of `df`; it only sets the number of hash ranges.
    """
    ranges = max(1, -(-rows // RANGE_ROWS))
    ranged = df.withColumn("_hash", F.md5(stable(F.col(key)))).withColumn("_range", hash_range(F.col("_hash"), F.lit(ranges)))
    counts = ranged.groupBy(shard, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(shard).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each shard and range
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(shard, "_range").orderBy("_hash", key, *ties)
    return (
        ranged.join(starts, [shard, "_range"])
        .withColumn("slot", F.col("_start") + F.row_number().over(inside) - 1)
        .drop("_hash", "_range", "_start")
    )


def placements(docs: DataFrame, shards: int = 16) -> DataFrame:
    """The law `key` for documents: shard by doc_id, grown_shard with one more shard of equal
    weight, slot in the shard, size (UTF-8 bytes plus 1) and crc32 of the text."""
    data = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    placed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(data).cast("long") + 1).alias("size"),
        F.crc32(data).alias("text_crc32"),
    )
    placed = assign(placed, "doc_id", [1.0] * shards)
    placed = assign(placed, "doc_id", [1.0] * (shards + 1), "grown_shard")
    slotted = with_slots(placed, "shard", "doc_id", ["size", "text_crc32"], docs.count())
    return slotted.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
