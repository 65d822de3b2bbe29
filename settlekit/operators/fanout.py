"""Row multiplicity of joins whose right side contributes no column.

An extra joined to its buyer rows and its form answers appears once per (buyer, answer) pair
even though neither table adds a column (J21, J33). Instead of joining the raw rows, each side
is counted per key (an aggregate, combined map-side, so a key with a third of all answers costs
one row after the first stage) and the item is repeated ``copies`` times at the end.

Repeating is always done in two steps: a row becomes one row per chunk of at most ``CHUNK``
copies, the chunk rows are rebalanced (AQE splits what is large and merges what is small), and
each chunk is expanded. A small chunk bounds how much larger than its input a task's output
gets, so the sizes that AQE balances by tell the work, and one hot item is expanded by many tasks.
The two steps need not follow each other: a job that knows the copies early cuts narrow rows into
chunks (:func:`chunked`) and expands them (:func:`expanded`) when all their columns are there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 64


def counts(df: DataFrame, key: str, out_key: str, out_count: str) -> DataFrame:
    """Rows per key; a null key meets nothing and is left out."""
    return df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(out_key)).agg(F.count(F.lit(1)).alias(out_count))


def chunked(df: DataFrame, copies: str) -> DataFrame:
    """Each row of ``df`` as rows of at most ``CHUNK`` copies each, rebalanced, that add up to its
    ``copies`` (null or < 1 counts as 1)."""
    one = F.lit(1).cast("long")
    n = F.greatest(F.coalesce(F.col(copies).cast("long"), one), one)
    cols = [c for c in df.columns if c != copies]
    last_chunk = F.floor((n - 1) / F.lit(CHUNK)).cast("long")
    chunks = df.select(*cols, n.alias("_n"), F.explode(F.sequence(F.lit(0).cast("long"), last_chunk)).alias("_chunk"))
    left = F.col("_n") - F.col("_chunk") * CHUNK
    return chunks.hint("rebalance").select(*cols, F.least(left, F.lit(CHUNK).cast("long")).alias(copies))


def expanded(df: DataFrame, copies: str) -> DataFrame:
    """Each row of a :func:`chunked` ``df`` ``copies`` times; drops ``copies``. Narrow."""
    cols = [c for c in df.columns if c != copies]
    return df.select(*cols, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies))).alias("_copy")).drop("_copy")


def replicate(df: DataFrame, copies: str) -> DataFrame:
    """Each row of ``df`` ``copies`` times (null or < 1 counts as 1); drops ``copies``."""
    return expanded(chunked(df, copies), copies)
