"""What the two searches over vectors share: cells, shards, two waves, and the best k.

*Cells.* Vectors are dealt over cells by place: a tree of halving planes, made from a sample of
about `SAMPLE_ROWS` vectors a cell, sends each vector to one cell, and a cell has one ball that
holds all its rows (the sample's centre, the largest distance over all rows). There are at most
about `MOST_CELLS` cells, whatever the input, so trees and balls are small and go to every task.
Cells of more than `SHARD_ROWS` rows are split over shards by the hash of the id.

*Waves.* In the first wave every query is searched in one shard of its own cell, next to its
neighbours; that gives a bound on its k-th result. In the second wave a query goes, with its bound,
only to the shards of those cells whose ball can hold a row within the bound, and a shard's index
prunes with the bound from the start. What is found is ranked per query. A task holds one shard
and about `QUERY_ROWS` of the queries that ask it.

*Copies.* Of rows with equal vectors only the k + 1 with the smallest ids can be among anyone's
best k, so only these are candidates: a vector that very many rows have does not make a cell large.
All rows whose id is divisible are queries all the same.

Rows that repeat an id: the one with the smallest vector (as an array) takes part, once for each
length. Vectors are compared with those of their own length only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from settlekit.llm.common import saved

SHARD_ROWS = 16_384
QUERY_ROWS = 16_384
MOST_CELLS = 1024
SAMPLE_ROWS = 16

#: search(ids, vectors, query ids, query vectors, bounds or None) -> (query number, id, score)
#: arrays: what each query finds among the rows, other than itself and within its bound.
Search = Callable[..., tuple[np.ndarray, np.ndarray, np.ndarray]]
#: reaches(queries, bounds, centres, radii) -> matrix: whether a ball may hold a row that is within
#: a query's bound (nan: no bound), for each query and ball.
Reaches = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def usable(vectors: DataFrame, id_column: str, vector_column: str, zero: bool) -> DataFrame:
    """(id, dim, v) of vectors that are not null, not empty and all finite; `zero`: all-zero ones too."""
    v = F.transform(F.col(vector_column), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull())
    good = (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.filter(good)
    if not zero:
        rows = rows.filter(F.exists("v", lambda x: x != 0))
    return rows.select("id", F.size("v").alias("dim"), "v")


def matrix(table: pa.Table | pa.RecordBatch, column: str) -> np.ndarray:
    """A list column, all of one length, as a matrix."""
    lists = table[column]
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)


def _ids(table: pa.Table, name: str) -> np.ndarray:
    return table[name].to_numpy()


class Cells:
    """Halving planes over vectors of one length; equal vectors get the same cell."""

    def __init__(self, sample: np.ndarray, most: int) -> None:
        self.planes: list[np.ndarray] = []
        self.limits: list[float] = []
        self.below: list[list[int]] = []  # a node, or -1 - its cell
        self.centres: list[np.ndarray] = []
        self.root = self._split(sample.astype(float), most)

    def _split(self, rows: np.ndarray, most: int) -> int:
        centre = rows.mean(axis=0)
        if most > 1 and len(rows) > 1:
            # along the line through two far rows
            a = rows[int(((rows - centre) ** 2).sum(axis=1).argmax())]
            b = rows[int(((rows - a) ** 2).sum(axis=1).argmax())]
            along = rows @ (b - a)
            limit = np.sort(along)[(len(rows) * (most // 2) - 1) // most]
            if limit >= along.max():  # the larger part is one value: it stays together
                limit = along[along < limit].max(initial=-np.inf)
            high = along > limit
            if np.isfinite(limit) and high.any():
                node = len(self.planes)
                self.planes.append(b - a)
                self.limits.append(float(limit))
                self.below.append([0, 0])
                self.below[node] = [self._split(rows[~high], most // 2), self._split(rows[high], most - most // 2)]
                return node
        self.centres.append(centre)
        return -len(self.centres)

    def place(self, rows: np.ndarray) -> np.ndarray:
        """The cell of each row."""
        at = np.full(len(rows), self.root)
        planes, limits, below = np.array(self.planes), np.array(self.limits), np.array(self.below)
        while len(inner := np.flatnonzero(at >= 0)):
            node = at[inner]
            high = np.einsum("ij,ij->i", rows[inner], planes[node]) > limits[node]
            at[inner] = below[node, high.astype(int)]
        return -1 - at


def cells_of(rows: DataFrame) -> dict[int, Cells]:
    """The cells of `rows` (dim, v), for each length with more than one cell."""
    sizes = dict(rows.groupBy("dim").count().collect())
    total = sum(sizes.values())
    most = {d: min(-(-n // SHARD_ROWS), -(-n * MOST_CELLS // total)) for d, n in sizes.items()}
    most = {d: n for d, n in most.items() if n > 1}
    if not most:
        return {}
    part = rows.filter(F.col("dim").isin(list(most)))
    share = SAMPLE_ROWS * max(n / sizes[d] for d, n in most.items())
    drawn = part.select("dim", "v").sample(min(1.0, share), seed=1).toArrow()
    found = {}
    for d, n in most.items():
        mine = drawn.filter(pa.array(_ids(drawn, "dim") == d))
        if mine.num_rows:
            found[d] = Cells(matrix(mine, "v"), n)
    return found


def placed(rows: DataFrame, trees: dict[int, Cells]) -> DataFrame:
    """`rows` (id, dim, v) with their cell and their distance from its centre, `away`."""
    shared = rows.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = _ids(batch, "dim")
            for d in np.unique(dims):
                part = batch.filter(pa.array(dims == d))
                x = matrix(part, "v").astype(float)
                tree = shared.value.get(int(d))
                with np.errstate(all="ignore"):
                    cell = tree.place(x) if tree else np.zeros(len(x), dtype=np.int64)
                    gap = x - np.array(tree.centres)[cell] if tree else x
                    away = np.sqrt((gap * gap).sum(axis=1))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell, pa.int32()), pa.array(away)], names=["id", "dim", "v", "cell", "away"])

    kind = rows.schema["v"].dataType.simpleString()
    return rows.select("id", "dim", "v").mapInArrow(run, f"id long, dim int, v {kind}, cell int, away double")


def _once(rows: DataFrame) -> DataFrame:
    """`rows` (id, dim, v) with each id once for a length, with its smallest vector."""
    repeated = saved(rows.groupBy("id", "dim").count().filter("count > 1").drop("count"))
    if repeated.isEmpty():
        return rows
    single = rows.join(repeated, ["id", "dim"]).groupBy("id", "dim").agg(F.min("v").alias("v"))
    return rows.join(repeated, ["id", "dim"], "left_anti").select("id", "dim", "v").unionByName(single)


class Balls:
    """The cells that have candidates: by length, number, centre, radius and shards of each."""

    def __init__(self, candidates: DataFrame, trees: dict[int, Cells]) -> None:
        rows = candidates.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("away")).collect()
        self.parts = {(r.dim, r.cell): -(-r.n // SHARD_ROWS) for r in rows}
        self.of: dict[int, tuple[np.ndarray, ...]] = {}
        for d in {r.dim for r in rows}:
            mine = sorted((r.cell, r.away) for r in rows if r.dim == d)
            number, radius = (np.array(x) for x in zip(*mine))
            centres = np.array(trees[d].centres)[number] if d in trees else np.zeros((1, d))
            parts = np.array([self.parts[d, c] for c in number.tolist()])
            self.of[d] = number, centres, radius * (1 + 1e-9) + 1e-9, parts


def route(first: DataFrame, balls: Balls, reaches: Reaches) -> DataFrame:
    """(id, dim, v, bound, cell, part): the shards, other than its own, that each query of `first`
    (id, dim, v, bound, cell, part) has to ask."""
    shared = first.sparkSession.sparkContext.broadcast(balls.of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = _ids(batch, "dim")
            for d in np.unique(dims):
                number, centres, radii, parts = shared.value[int(d)]
                mine = batch.filter(pa.array(dims == d))
                for begin in range(0, mine.num_rows, 1024):
                    some = mine.slice(begin, 1024)
                    bounds = some["bound"].to_numpy(zero_copy_only=False).astype(float)  # null: nan
                    with np.errstate(all="ignore"):
                        query, ball = np.nonzero(reaches(matrix(some, "v").astype(float), bounds, centres, radii))
                    times = parts[ball]
                    part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    query, cell = np.repeat(query, times), np.repeat(number[ball], times)
                    other = (cell != _ids(some, "cell")[query]) | (part != _ids(some, "part")[query])
                    query, cell, part = query[other], cell[other], part[other]
                    for at in range(0, len(query), 4096):
                        span = slice(at, at + 4096)
                        kept = some.take(pa.array(query[span]))
                        yield pa.RecordBatch.from_arrays(
                            [*(kept[c] for c in ("id", "dim", "v", "bound")), pa.array(cell[span], pa.int32()), pa.array(part[span], pa.int32())],
                            names=["id", "dim", "v", "bound", "cell", "part"],
                        )

    kind = first.schema["v"].dataType.simpleString()
    return first.select("id", "dim", "v", "bound", "cell", "part").mapInArrow(
        run, f"id long, dim int, v {kind}, bound double, cell int, part int"
    )


def _asking(candidates: DataFrame, asked: DataFrame, balls: Balls, task: Callable, schema: str) -> DataFrame:
    """`task` over each shard of `candidates` (id, dim, v, cell) and each group of the queries `asked`
    (id, dim, v, bound, cell, part) that ask it. A shard is repeated for its groups."""
    counts = asked.groupBy("dim", "cell").count().collect()  # a row for each cell
    groups = [(r.dim, r.cell, p := balls.parts.get((r.dim, r.cell), 1), max(1, -(-r["count"] // (p * QUERY_ROWS)))) for r in counts]
    cells = F.broadcast(asked.sparkSession.createDataFrame(groups, "dim int, cell int, parts int, groups int"))
    shards = candidates.join(cells, ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    shards = shards.withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).select("id", "dim", "v", "cell", "part", "turn")
    turn = F.pmod(F.xxhash64(F.col("id"), F.lit("group")), F.col("groups")).cast("int")
    queries = asked.join(cells, ["dim", "cell"]).withColumn("turn", turn).drop("parts", "groups")
    keys = ["dim", "cell", "part", "turn"]
    return shards.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(task, schema)


def search(rows: DataFrame, every: int, k: int, prepare: Column, score: str, largest: bool, run: Search, reaches: Reaches) -> DataFrame:
    """query_id, rank, vec_id, score: the best k of all `rows` (id, dim, v) for each row whose id
    is divisible by `every`. `prepare` maps v to the searched vector; `score` is a Spark type;
    `run` searches one shard and returns at least each query's best k there within its bound."""
    rows = _once(rows.select("id", "dim", prepare.alias("v")))
    kind = rows.schema["v"].dataType.simpleString()
    trees = cells_of(rows)
    copies = Window.partitionBy("dim", "v").orderBy("id")
    candidates = rows.withColumn("copy", F.row_number().over(copies)).filter(F.col("copy") <= k + 1)
    candidates = saved(placed(candidates, trees))
    balls = Balls(candidates, trees)
    value = pa.int64() if score == "long" else pa.float64()

    def hits(left: pa.Table, right: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query number, id, score) of the best k in the shard `left` for the queries `right`."""
        if not left.num_rows or not right.num_rows:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        ids = _ids(left, "id")
        order = np.argsort(ids)
        bounds = right["bound"].to_numpy(zero_copy_only=False).astype(float)  # null: nan
        found = run(ids[order], matrix(left, "v")[order], _ids(right, "id"), matrix(right, "v"), bounds)
        return best(*found, k, largest)

    def own(left: pa.Table, right: pa.Table) -> pa.Table:
        number, found, scores = hits(left, right)
        starts = np.searchsorted(number, np.arange(right.num_rows + 1)).astype(np.int32)
        table = right.select(["id", "dim", "v", "cell", "part"])
        table = table.append_column("vec_id", pa.ListArray.from_arrays(starts, pa.array(found, pa.int64())))
        return table.append_column("score", pa.ListArray.from_arrays(starts, pa.array(scores, value)))

    def others(left: pa.Table, right: pa.Table) -> pa.Table:
        number, found, scores = hits(left, right)
        names = _ids(right, "id")[number] if right.num_rows else number
        return pa.table({"query_id": pa.array(names, pa.int64()), "vec_id": pa.array(found, pa.int64()), "score": pa.array(scores, value)})

    shards = [(d, c, n) for (d, c), n in balls.parts.items()]
    cells = F.broadcast(rows.sparkSession.createDataFrame(shards, "dim int, cell int, parts int"))
    part = F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).cast("int")
    queries = placed(rows.filter(F.col("id") % every == 0), trees).join(cells, ["dim", "cell"], "left")
    queries = queries.select("id", "dim", "v", F.lit(None).cast("double").alias("bound"), "cell", part.alias("part"))
    schema = f"id long, dim int, v {kind}, cell int, part int, vec_id array<long>, score array<{score}>"
    first = saved(_asking(candidates, queries, balls, own, schema))
    found = first.select(F.col("id").alias("query_id"), F.explode(F.arrays_zip("vec_id", "score")).alias("x")).select("query_id", "x.vec_id", "x.score")
    if sum(balls.parts.values()) > 1:
        bound = F.when(F.size("score") >= k, F.element_at("score", k)).cast("double")
        asked = route(first.withColumn("bound", bound), balls, reaches)
        found = found.unionByName(_asking(candidates, asked, balls, others, f"query_id long, vec_id long, score {score}"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score") if largest else F.asc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def best(number: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int, largest: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best k of each query, best first, ties to the smaller id; sorted by query number."""
    order = np.lexsort((ids, -scores if largest else scores, number))
    number, ids, scores = number[order], ids[order], scores[order]
    place = np.arange(len(number)) - np.searchsorted(number, number)
    keep = place < k
    return number[keep], ids[keep], scores[keep]
