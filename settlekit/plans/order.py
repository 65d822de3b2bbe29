"""The ordered ledger as files (O01): sorted once, read back without a sort.

`ledger.ordered` sorts whatever reads it, and its range exchange runs the plan below it twice:
once for the sample that its bounds come from, once for the rows. Here a ledger that has been
written (`jobs.write_ledger`) is cut into ranges of (order descending, item, instalment,
settlement date): the bounds come from a sample of these four columns of the files, every row
goes straight to the range it belongs to (``repartitionByRange``), and each range is sorted and
written as one file. File names follow the order, so

* :func:`ordered_files` says from the columns' values what each file holds,
* :func:`newest` reads the newest rows from the first files alone,
* :func:`positions` numbers all rows: the files before a row's own, plus its place in it.

`ledger_ordered` returns a DataFrame in order instead, and works on items, before they become
instalments: :func:`item_cuts` draws the bounds of ranges from the items' keys, :func:`in_ranges` writes the
items a few ranges at a time, a file for each, and reads these files as partitions in order. What a
shuffle holds on disk is then a few ranges of narrow rows, whatever the size of the ledger.

A key that fills several ranges (an extra that the source repeats very often) is dealt over all of
them: its rows are equal in every sort column, so any of them may come first.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shuffles_freed

#: Sampled keys for each range: the largest of a thousand ranges is then about a half above the mean.
SAMPLED = 64
#: Rows of a range, which one task sorts.
RANGE_ROWS = 2_000_000
#: Items of a range of :func:`in_ranges`; small ledgers have fewer, so that all cores have one.
RANGE_ITEMS = 250_000
FEW_ITEMS = 50_000
#: Ranges beyond which they become larger instead, as the driver plans a scan for each, unless these are
#: fewer than so many turns of all cores.
MOST_RANGES, LEAST_TURNS = 72, 4
#: Ranges that rows with equal sort keys may fill.
TIES = 10_000


def sort_key() -> Column:
    """The order of `ledger.ordered` as one ascending struct: newest (greatest) order first, an
    order that is null last; nulls of the other columns first."""
    c = F.col
    return F.struct(
        c("order_id").isNull().alias("none"),
        F.bitwise_not(c("order_id")).alias("newest"),
        c("item_id").alias("item"),
        c("instalment_no").alias("instalment"),
        c("settlement_date").alias("settled"),
    )


def bounds(written: DataFrame, ranges: int, sampled: int = SAMPLED) -> list:
    """At most ``ranges - 1`` sort keys, ascending, that cut the rows into about equal ranges; a
    key with very many rows may come several times. About ``ranges * sampled`` keys are drawn
    (by row, repeatably) and come to the driver, whatever the number of rows."""
    rows = written.count()
    if ranges <= 1 or not rows:
        return []
    keys = written.select(sort_key().alias("key"))
    share = min(1.0, ranges * sampled / rows)
    drawn = keys if share == 1.0 else keys.sample(False, share, seed=7)
    found = [r.key for r in drawn.orderBy("key").collect()]
    return [found[len(found) * i // ranges] for i in range(1, ranges)] if found else []


def ranges_for(written: DataFrame, least: int = 1) -> int:
    """How many ranges to cut a written ledger into: ``RANGE_ROWS`` rows each, ``least`` at least.
    The count comes from the footers of the files."""
    return max(least, -(-written.count() // RANGE_ROWS))


def write_ordered(written: DataFrame, path: str, ranges: int) -> DataFrame:
    """Write a ledger to ``path`` in the order of `ledger.ordered`, a file for each of ``ranges``
    (fewer if some stay empty); return a DataFrame that reads it, file by file in no order.

    ``written`` should read files (`jobs.write_ledger`): it is read twice, the first time for the
    sample that the ranges' bounds come from (a few hundred keys for each range). An empty ledger
    gives a folder without rows."""
    sort = [F.col("order_id").desc(), "item_id", "instalment_no", "settlement_date"]
    # the last key tells apart rows that are equal in the others, so that they fill ranges evenly
    spread = written.withColumn("_tie", F.pmod(F.monotonically_increasing_id(), F.lit(TIES)).cast("int"))
    placed = spread.repartitionByRange(ranges, *sort, "_tie").drop("_tie")
    placed.sortWithinPartitions(*sort).write.mode("overwrite").parquet(path)
    return written.sparkSession.read.schema(written.schema).parquet(path)


def _file_no(name: Column) -> Column:
    """The number of a file from its name, part-00012-...: the order of the ranges."""
    return F.regexp_extract(name, r"part-(\d+)-", 1).cast("int")


def ordered_files(spark: SparkSession, path: str) -> DataFrame:
    """`file_no` (ascending with the order), `rows`, `newest_order` and `oldest_order` of each file."""
    rows = spark.read.parquet(path).select("order_id", _file_no(F.col("_metadata.file_name")).alias("file_no"))
    return rows.groupBy("file_no").agg(
        F.count(F.lit(1)).alias("rows"), F.max("order_id").alias("newest_order"), F.min("order_id").alias("oldest_order")
    )


def newest(spark: SparkSession, path: str, rows: int) -> DataFrame:
    """The first ``rows`` rows of an ordered ledger, in order, from as few of its files as hold
    them; nothing is sorted."""
    files = sorted(spark.read.parquet(path).inputFiles(), key=lambda f: f.rsplit("/", 1)[-1])
    sizes = {r.file_no: r.rows for r in ordered_files(spark, path).select("file_no", "rows").collect()}
    taken, have = [], 0
    for file in files:
        if have >= rows and taken:
            break
        have += sizes.get(int(file.rsplit("/", 1)[-1].split("-")[1]), 0)
        taken.append(file)
    out = None
    for file in taken:
        part = spark.read.parquet(file)
        out = part if out is None else out.unionAll(part)
    return (spark.read.parquet(path) if out is None else out).limit(rows)


def positions(spark: SparkSession, path: str) -> DataFrame:
    """The rows of an ordered ledger with `position`, their place in it from 1. The files' row
    counts (as many as there are files) are added up and broadcast; a row's place in its own file
    comes from the reader."""
    files = ordered_files(spark, path).select("file_no", "rows").collect()
    before, sizes = 0, []
    for file in sorted(files):
        sizes.append((file.file_no, before))
        before += file.rows
    starts = F.broadcast(spark.createDataFrame(sizes, "_file int, _before long"))
    rows = spark.read.parquet(path)
    rows = rows.select("*", _file_no(F.col("_metadata.file_name")).alias("_file"), F.col("_metadata.row_index").alias("_row"))
    return rows.join(starts, "_file").withColumn("position", F.col("_before") + F.col("_row") + 1).drop("_file", "_row", "_before")


def item_cuts(keys: DataFrame, at_once: int, sampled: int = SAMPLED) -> list[tuple[int, int]]:
    """Keys (order, item), in the order of `ledger.ordered` and distinct, that cut items with these ``keys`` (order_id,
    item_id) into ranges of about ``RANGE_ITEMS``, more if there are very many, less if there are not enough
    for ``at_once``. About ``sampled`` keys for each range are drawn, repeatably, and come to the driver."""
    keys = keys.where(F.col("order_id").isNotNull() & F.col("item_id").isNotNull())
    rows = keys.count()
    most = max(MOST_RANGES, LEAST_TURNS * at_once)
    ranges = max(min(most, -(-rows // RANGE_ITEMS)), min(at_once, -(-rows // FEW_ITEMS)))
    if ranges <= 1:
        return []
    found = keys.sample(False, min(1.0, ranges * sampled / rows), seed=7).collect()
    found = sorted((-r.order_id, r.item_id) for r in found)
    cuts = sorted({found[len(found) * i // ranges] for i in range(1, ranges)}) if found else []
    return [(-newest, item) for newest, item in cuts]


def _reached(cut: tuple[int, int]) -> Column:
    """Whether an item comes with or after the cut; one without an id is the first of its order."""
    order, item = F.col("order_id"), F.col("item_id")
    return (order < cut[0]) | ((order == cut[0]) & F.coalesce(item >= cut[1], F.lit(False)))


def in_ranges(items: DataFrame, cuts: list[tuple[int, int]], at_once: int, path: str) -> DataFrame:
    """``items`` (order_id, never null, item_id and more) by the ranges between ``cuts``: a partition for each, in
    the order of `ledger.ordered`. They are written to ``path`` first, ``at_once`` ranges at a time, and what
    was shuffled for these is given back. ``items`` should filter tables by order cheaply: it runs once for
    each time."""
    spark, files = items.sparkSession, []
    for first in range(0, len(cuts) + 1, at_once):
        inner = cuts[first : first + at_once - 1]
        some = items
        # the orders' bounds reach the scans
        if first:
            some = some.where((F.col("order_id") <= cuts[first - 1][0]) & _reached(cuts[first - 1]))
        if first + at_once <= len(cuts):
            end = cuts[first + at_once - 1]
            some = some.where((F.col("order_id") >= end[0]) & ~_reached(end))
        number = reduce(add, [_reached(c).cast("int") for c in inner], F.lit(0))
        some = some.withColumn("_range", number).repartitionById(len(inner) + 1, "_range").drop("_range")
        part = f"{path}/{first:08d}"
        with shuffles_freed(spark):
            # in order, a column of orders or of tickets takes few bytes
            some.sortWithinPartitions(F.col("order_id").desc(), "item_id").write.option("compression", "zstd").parquet(part)
        found = spark.read.schema(items.schema).parquet(part).inputFiles()
        files += sorted(found, key=lambda f: f.rsplit("/", 1)[-1])
    # Spark would make one partition of a union whose parts all have one: the first of these is a table without rows,
    # of which it does not know that
    items.limit(0).write.parquet(f"{path}/none")
    none = spark.read.schema(items.schema).parquet(f"{path}/none")
    # a large file is read by one task too: its rows with equal keys belong together
    parts = [none, *(spark.read.schema(items.schema).parquet(f).coalesce(1) for f in files)]
    while len(parts) > 1:
        parts = [parts[i].unionAll(parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return _never_null(parts[0], items)


def _never_null(read: DataFrame, like: DataFrame) -> DataFrame:
    """``read`` with the columns never null that are so in ``like``: files mark every column nullable."""
    filler = {"string": "", "boolean": False}
    found = []
    for f in like.schema:
        kind = f.dataType.simpleString()
        plain = f.nullable or kind.startswith(("array", "struct", "map", "date", "timestamp"))
        found.append(F.col(f.name) if plain else F.coalesce(F.col(f.name), F.lit(filler.get(kind, 0)).cast(f.dataType)).alias(f.name))
    return read.select(*found)
