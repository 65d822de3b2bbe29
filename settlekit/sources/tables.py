"""The 28 input tables as one object, read from parquet or handed in as DataFrames."""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from .schemas import SCHEMAS, TABLE_NAMES


class Tables(Mapping):
    """Read-only mapping ``name -> DataFrame`` of the 28 checkout tables.

    Attribute access works too (``tables.checkoutsession``). Every frame is projected to its
    declared schema, so Catalyst prunes unread columns down to the parquet scan.
    """

    #: Whether the session facts are bucketed by session id (:func:`read_bucketed`).
    bucketed = False
    #: Writes a part of a plan and reads it again as a table (:meth:`in_parts`).
    keep: Callable[[DataFrame], DataFrame] | None = None
    #: The same for the lines of each branch, while they are a few columns wide.
    keep_lines: Callable[[DataFrame], DataFrame] | None = None

    def __init__(self, frames: Mapping[str, DataFrame]):
        missing = [name for name in TABLE_NAMES if name not in frames]
        if missing:
            raise KeyError(f"missing input tables: {missing}")
        self._frames = {
            name: frames[name].select(*[f.name for f in SCHEMAS[name].fields])
            for name in TABLE_NAMES
        }
        self._parts: dict[str, DataFrame] = {}

    def with_frames(self, **frames: DataFrame) -> Tables:
        """A table set with some tables replaced."""
        found = Tables({**self._frames, **frames})
        found.keep, found.keep_lines = self.keep, self.keep_lines
        return found

    def in_parts(
        self, keep: Callable[[DataFrame], DataFrame], keep_lines: Callable[[DataFrame], DataFrame] | None = None
    ) -> Tables:
        """This table set for a plan in parts: what joins many tables, the order context and each catalogue, is
        handed to ``keep``, which writes it and returns it as a table; so are the lines of each branch to
        ``keep_lines``, if given, before they meet their catalogue."""
        found = self.with_frames()
        found.keep, found.keep_lines = keep, keep_lines
        return found

    def lines_part(self, df: DataFrame) -> DataFrame:
        """``df``, the lines of a branch, as a table if this set is :meth:`in_parts` with ``keep_lines``."""
        return df if self.keep_lines is None else self.keep_lines(df)

    def part(self, df: DataFrame, name: str | None = None) -> DataFrame:
        """``df`` as a table if this set is :meth:`in_parts`. What depends on these tables alone has a
        ``name`` and is written once."""
        if self.keep is None:
            return df
        if name is None:
            return self.keep(df)
        if name not in self._parts:
            self._parts[name] = self.keep(df)
        return self._parts[name]

    def _as_bucketed(self, frames: Mapping[str, DataFrame]) -> Tables:
        found = self.with_frames(**frames)
        found.bucketed = True
        return found

    def __getitem__(self, name: str) -> DataFrame:
        return self._frames[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        try:
            return self._frames[name]
        except KeyError as exc:
            raise AttributeError(name) from exc

    def __iter__(self):
        return iter(self._frames)

    def __len__(self) -> int:
        return len(self._frames)


def read_tables(spark: SparkSession, root: str, fmt: str = "parquet") -> Tables:
    """Read ``<root>/<table>`` (a file or a folder of files) for each of the 28 tables."""
    frames = {}
    for name, schema in SCHEMAS.items():
        path = os.path.join(root, name)
        if fmt == "parquet" and not os.path.exists(path) and os.path.exists(path + ".parquet"):
            path += ".parquet"
        frames[name] = spark.read.schema(schema).format(fmt).load(path)
    return Tables(frames)


# Storage layout of the fact tables: the key each one is joined on. Writing them range-partitioned
# and sorted on it gives several files per table (parallel scans) whose min/max statistics let
# id filters skip files and row groups.
CLUSTER_KEYS: dict[str, str] = {
    "checkoutsession": "id",
    "checkoutsummary": "sessionid",
    "checkoutpayment": "sessionid",
    "checkoutpaypaldetails": "sessionId",
    "checkoutbuyer": "sessionId",
    "checkoutparticipant": "sessionid",
    "checkoutproductcomplement": "sessionId",
    "checkoutorderticketpartialcancel": "participantId",
    "checkoutorderproductpartialcancel": "checkoutProductComplementId",
    "checkoutproductcomplementanswer": "checkoutProductComplementId",
    "tradecheckoutsession": "originalParticipantId",
    "customerpaymentprovidercard": "cardId",
    "checkouteventticketbatchprice": "id",
}


def write_tables(tables: Tables, root: str, fmt: str = "parquet", files: int | None = None) -> None:
    """Write each table to ``<root>/<table>``; used to materialise fixtures once.

    Fact tables are clustered on their join key into ``files`` files (default: the session's
    default parallelism); the others are written as they come.
    """
    spark = next(iter(tables.values())).sparkSession
    files = files or spark.sparkContext.defaultParallelism
    for name in TABLE_NAMES:
        df = tables[name]
        key = CLUSTER_KEYS.get(name)
        if key:
            df = df.repartitionByRange(files, key).sortWithinPartitions(key)
        df.write.mode("overwrite").format(fmt).save(os.path.join(root, name))


# The tables with a few rows per checkout session, by the column that holds the session's id.
SESSION_FACTS = {name: CLUSTER_KEYS[name] for name in (
    "checkoutsession", "checkoutsummary", "checkoutpayment", "checkoutpaypaldetails", "checkoutbuyer"
)}


def _bucket_folder(root: str, buckets: int, name: str) -> str:
    # the number is part of the path: files read with another number of buckets would lose rows
    return f"{root.rstrip('/')}/buckets-{buckets}/{name}"


def write_bucketed(tables: Tables, root: str, buckets: int) -> None:
    """Write the session facts (``SESSION_FACTS``) under ``root``, a folder that all executors share, in
    ``buckets`` buckets by session id, one file sorted by it for each.

    A bucket is a task of the joins that follow: choose bytes / 128 MB of the largest table. Session
    ids are spread by their hash; a null id (which joins nothing) goes to the first bucket.
    """
    for name, key in SESSION_FACTS.items():
        df, path = tables[name], _bucket_folder(root, buckets, name)
        table = f"settlekit_written_{uuid.uuid4().hex}"
        # one task writes a bucket: the shuffle is by the hash that the buckets go by
        writer = df.repartition(buckets, key).write.mode("overwrite").format("parquet").option("path", path)
        writer.bucketBy(buckets, key).sortBy(key).saveAsTable(table)
        df.sparkSession.sql(f"DROP TABLE {table}")  # an external table: its files stay


def read_bucketed(tables: Tables, spark: SparkSession, root: str, buckets: int) -> Tables:
    """``tables`` with the session facts that :func:`write_bucketed` wrote: joins and groups by session
    id need no shuffle. The five tables are entered, under names of their own, in the catalogue of this
    session; a number of ``buckets`` that nothing was written with is an error."""
    frames = {}
    for name, key in SESSION_FACTS.items():
        path = _bucket_folder(root, buckets, name)
        schema = SCHEMAS[name]
        spark.read.schema(schema).parquet(path)  # fails if the folder is not there
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        table = f"settlekit_{name}_{zlib.crc32(path.encode()):08x}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet"
            f" CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{path}'"
        )
        spark.catalog.refreshTable(table)
        frames[name] = spark.table(table)
    return tables._as_bucketed(frames)
