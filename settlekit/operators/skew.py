"""Hot keys: split a join key that holds too many rows over several tasks.

AQE's skew-join split only applies when both join inputs are plain shuffle stages and nothing
downstream depends on the join's partitioning. The ledger's big join (items x order context)
sits on a chain of joins on the same key, so an order holding a third of all items would be
joined by one task. :func:`split_join` gives both sides a plain shuffle for that join, and AQE
splits a hot partition at run time, with sizes that it measures anyway: no table is read twice to
find hot keys. This is what the ledger does unless ``Params.hot_key_rows`` is set.

With ``hot_key_rows`` (for a session without AQE, or with map tasks so large that one map output
of a key is too much) hot keys are found and salted explicitly:

1. rows per key are counted with a partial (map-side) aggregate, inside the plan of the join; the
   keys above ``hot_rows`` are hot. They number at most rows / ``hot_rows`` (5,000 in 10 billion
   rows at 2 million), which bounds their broadcast;
2. a row of the large side with a hot key gets a salt in ``[0, salts)`` from a hash of a
   column that varies within the key, and the small side's rows for that key are repeated once
   per salt; every other key has salt 0 and is not repeated;
3. the join runs on ``(key, salt)``, so a hot key is spread over ``salts`` tasks.

Neither changes the result: each large-side row meets exactly the rows it met before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def hot_keys(keys: DataFrame, key: str, hot_rows: int) -> DataFrame:
    """``(hot_key, salts)`` for the keys of ``keys`` with more than ``hot_rows`` rows."""
    counts = keys.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    hot = counts.where(F.col("rows") > hot_rows)
    return hot.select(F.col(key).alias("hot_key"), F.ceil(F.col("rows") / F.lit(hot_rows)).cast("int").alias("salts"))


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is never broadcast. The planner takes a table that grows with
    the input for a small one: it goes by the bytes of compressed files, less the columns that are
    not read, and each such broadcast is tens of times larger in the driver."""
    return df.hint("shuffle_hash")


def split_join(large: DataFrame, small: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``large.join(small, key, how)`` that AQE can split.

    The second join key is 0 for every row, but the planner does not know that: both sides get a
    shuffle of their own for this join, whatever they were partitioned by, and nothing downstream
    relies on it, so a hot partition of the large side is read in several pieces by map output.
    """
    # never null, or the planner would filter it, and scans that are the same but for that filter
    # would not be shared
    same = F.coalesce(F.pmod(F.xxhash64(key), F.lit(1)).cast("int"), F.lit(0))
    return large.withColumn("_one", same).join(small.withColumn("_one", same), [key, "_one"], how).drop("_one")


def join_spread(large: DataFrame, small: DataFrame, key: str, hot: DataFrame | None, spread_by: Column, how: str = "inner") -> DataFrame:
    """:func:`split_join`, or :func:`salted_join` if ``hot`` keys are given."""
    return split_join(large, small, key, how) if hot is None else salted_join(large, small, key, hot, spread_by, how)


def salted_join(
    large: DataFrame, small: DataFrame, key: str, hot: DataFrame, spread_by: Column, how: str = "inner"
) -> DataFrame:
    """``large.join(small, key, how)`` with the keys in ``hot`` split over several tasks.

    ``hot`` comes from :func:`hot_keys`; ``spread_by`` is a column of ``large`` that varies
    within a key (e.g. the item id).
    """
    h = F.broadcast(hot)
    n = F.coalesce(F.col("salts"), F.lit(1))
    big = (
        large.join(h, large[key] == h.hot_key, "left")
        .withColumn("_salt", F.pmod(F.xxhash64(spread_by), n).cast("int"))
        .drop("hot_key", "salts")
    )
    rep = (
        small.join(h, small[key] == h.hot_key, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), n - 1)))
        .drop("hot_key", "salts")
    )
    return big.join(rep, [key, "_salt"], how).drop("_salt")
