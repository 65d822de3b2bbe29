"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from settlekit.session import checkpoint_dir

#: A key with more than one row in so many is hot; there are fewer than this many such keys.
HOT_PARTS = 1000
#: Rows in a batch for a Python worker, in a pipeline whose rows are whole texts.
BATCH_ROWS = 1024
#: Bytes of a batch for a Python worker, about, where rows are large.
BATCH_BYTES = 4 << 20


def saved(df: DataFrame, parts: int | None = None) -> DataFrame:
    """`df` written to the shared checkpoint folder, with its lineage cut. `parts` is a most
    number of partitions, from its number of rows: small tables are not written, and shuffled
    from there, as very many small files."""
    checkpoint_dir(df.sparkSession)
    return (df.coalesce(parts) if parts else df).checkpoint(eager=True)


def bounded_batches(spark: SparkSession) -> None:
    """Sessions send Python workers 10,000 rows at a time: of whole texts tens of MB for each task, held
    by the executor outside its heap, by the worker, and once more on the way back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Within, Python workers get about `BATCH_BYTES` at a time, instead of 64 MB: the executor holds a
    batch outside its heap, in buffers that double as they grow, and the worker holds it once more.
    For jobs that run within; the session's own limit counts again after, and counts if it is lower."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    number = before.rstrip("bB")  # others: no limit, or one in MB and more
    spark.conf.set(key, str(min(int(number) if number.isdigit() and int(number) else BATCH_BYTES, BATCH_BYTES)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


_HELD: dict[str, Any] = {}


def held(key: str, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps for its next tasks, made at first use. It keeps one thing at a
    time, so the models and caches of a pipeline's stages do not add up."""
    if key not in _HELD:
        _HELD.clear()
        pa.default_memory_pool().release_unused()
        _HELD[key] = make()
    return _HELD[key]


def crc_of_id(column: str) -> Column:
    """crc32 of an id written as text (null for a null id)."""
    return F.crc32(F.encode(F.col(column).cast("string"), "UTF-8"))


def stable(key: Column) -> Column:
    """A key as text for hashing; a null key is the empty text."""
    return F.coalesce(key.cast("string"), F.lit(""))


def hash_bits(md5: Column, digits: int) -> Column:
    """The first hex digits of an md5 (at most 13, 52 bits) as a double."""
    return F.conv(F.substring(md5, 1, digits), 16, 10).cast("double")


def hash_range(md5: Column, ranges: Column) -> Column:
    """Which of `ranges` equal hash ranges (0 and up) an md5 falls into, in the order of md5s."""
    return F.floor(hash_bits(md5, 12) / F.lit(float(1 << 48)) * ranges).cast("int")


def lookup(left: DataFrame, groups: DataFrame, key: str, rows: int) -> DataFrame:
    """Inner join of `left` with one row of `groups` (columns key, n, ...) per key.

    `n` is the key's number of rows in `left`, `rows` all of them. Keys above rows / HOT_PARTS
    number fewer than HOT_PARTS whatever the input, so their groups are broadcast and their rows
    stay where they are; a task of the shuffled join gets no larger key than that. `left` is
    read twice and should be a written table.
    """
    hot = F.col("n") * HOT_PARTS > F.lit(rows)
    hottest = F.broadcast(groups.filter(hot))
    spread = left.join(hottest, key)
    rest = left.join(F.broadcast(groups.filter(hot).select(key)), key, "left_anti").join(
        groups.filter(~hot), key
    )
    return spread.unionByName(rest).drop("n")
