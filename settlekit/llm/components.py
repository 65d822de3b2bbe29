"""Connected components of a graph given as edges.

1. *Contraction.* Each task joins the edges of its own partition (union-find) and hands on one edge
   for each node that is not the smallest of its part of the graph. Where all edges of a component
   lie in one partition it is done.
2. *Stars.* Alternating large-star and small-star steps link what several tasks hold: a node's
   larger neighbours go to its smallest one, then its smaller neighbours do. Each step is a map-side
   combined aggregation and a salted join and is saved to the shared folder. It ends when every
   node has one link and no node is linked that others are linked to; the number of rounds grows
   with the logarithm of the longest path.

Edge cases: no edges give no rows; an edge with a null end, or of a node with itself, links nothing
and its nodes are in no row; repeated edges count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from settlekit.llm.common import saved

#: Edges in a partition, at least.
PART_ROWS = 100_000
#: Parts that a node's neighbours are spread over.
SALTS = 16


def contracted(edges: DataFrame) -> DataFrame:
    """(u, v): each node of a partition's edges (a, b), with the smallest node that it reaches by
    them; smallest nodes have no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict = {}

        def top(x):
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        kinds = None
        for batch in batches:
            kinds = batch.schema.field(0).type
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x, y = top(a), top(b)
                if x != y:
                    root[max(x, y)] = min(x, y)
        found = [(x, top(x)) for x in list(root)]
        found = [x for x in found if x[0] != x[1]]
        for at in range(0, len(found), 1 << 16):
            u, v = zip(*found[at : at + (1 << 16)])
            yield pa.RecordBatch.from_arrays([pa.array(u, kinds), pa.array(v, kinds)], names=["u", "v"])

    kind = edges.schema["a"].dataType.simpleString()
    return edges.select("a", "b").filter("a <> b").mapInArrow(run, f"u {kind}, v {kind}")


def _star(pairs: DataFrame, least: DataFrame) -> DataFrame:
    """(v, m) for each (u, v) of `pairs`, with m of `least` (u, m). A node with very many neighbours
    is spread: pairs are salted by v, and `least` is repeated for each salt."""
    salted = pairs.withColumn("_salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    spread = least.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(spread, ["u", "_salt"]).select("v", "m")


def _settled(links: DataFrame) -> bool:
    """Whether `links` (u, v) are stars: each u has one v, which is no other link's u."""
    ends = links.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        links.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    both = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return both.filter("up > 1 OR up = 1 AND down = 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of `edges` (a, b), which should be a written table; root is the
    component's smallest node."""
    parts = max(1, -(-edges.count() // PART_ROWS))
    links = saved(contracted(edges.coalesce(parts)))
    while not (parts == 1 or _settled(links)):
        # large star: a node's larger neighbours go to its smallest neighbour (or itself)
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = least.withColumn("m", F.least("m", "u"))
        large = _star(both.filter("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = saved(large.filter("u <> v").distinct(), parts)
        # small star: a node's smaller neighbours, and itself, go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _star(large, least).unionByName(least.select(F.col("u").alias("v"), "m"))
        links = saved(small.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), parts)
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
