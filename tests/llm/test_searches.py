"""Searches over vectors against brute force, and their recall."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from settlekit.llm import ann, topk, vectors
from settlekit.llm.queries import QUERIES
from settlekit.llm.sql import SQL

ROWS = "vec_id long, embedding array<float>, label int"
SF01, SF1 = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


def clustered(n, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    x = centres[rng.integers(0, 12, n)] + 0.4 * rng.normal(size=(n, dim))
    x[rng.random(n) < 0.1] = x[0]  # one vector that a tenth of all rows have
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], ROWS).repartition(4)


def brute_topk(x, every, k):
    q = np.floor(256 * x.astype(float)).astype(np.int64)
    out = []
    for i in range(0, len(x), every):
        scores = sorted(((-int(s), j) for j, s in enumerate(q @ q[i]) if j != i))[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores)]
    return out


@pytest.mark.parametrize("shard_rows", [100_000, 300])
def test_topk_is_exact(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(vectors, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(vectors, "QUERY_ROWS", 20 if shard_rows == 300 else 100_000)
    x = clustered(2000)
    got = sorted(map(tuple, topk.inner_products(frame(spark, x), 50, 5).collect()))
    assert got == brute_topk(x, 50, 5)


def test_bounds_prune_and_are_shared():
    x = np.floor(256 * clustered(4000).astype(float))
    ids, tree = np.arange(4000), topk.BallTree(np.floor(256 * clustered(4000).astype(float)))
    queries = x[:64]
    *_, alone = topk.search_tree(tree, ids, ids[:64], queries, None, 5)
    number, found, scores, _ = topk.search_tree(tree, ids, ids[:64], queries, None, 5)
    least = np.array([scores[number == i].min() for i in range(64)])
    *_, helped = topk.search_tree(tree, ids, ids[:64], queries, least, 5)
    leaves = sum(c is None for c in tree.children) * 64
    assert helped <= alone < leaves


def far_apart(n=20_000, dim=32):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(24, dim))
    return centres[rng.integers(0, 24, n)] + 0.05 * rng.normal(size=(n, dim))


@pytest.mark.parametrize("near", [True, False])
def test_a_query_asks_only_cells_in_reach(spark, monkeypatch, near):
    monkeypatch.setattr(vectors, "SHARD_ROWS", 500)
    x, asked = far_apart(6000), []
    pairs = vectors.route
    monkeypatch.setattr(vectors, "route", lambda first, balls, reaches: asked.append((pairs(first, balls, reaches).count(), balls)) or pairs(first, balls, reaches))
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    if near:
        assert {(r.query_id, r.vec_id) for r in ann.nearest(df, 100, 3).collect()} >= {
            (i, int(j)) for i in (0, 300) for j in np.argsort(((x - x[i]) ** 2).sum(axis=1))[1:2]
        }
    else:
        assert sorted(map(tuple, topk.inner_products(df, 100, 5).collect())) == brute_topk(x, 100, 5)
    (n, balls), = asked
    assert sum(balls.parts.values()) >= 12
    assert n < 60 * sum(balls.parts.values()) / 2


def test_cells_hold_all_rows_and_copies_stay_together():
    x = clustered(3000)
    for sample in (x[:200], np.repeat(x[:1], 50, axis=0), x[:1]):
        tree = vectors.Cells(sample, 12)
        cell = tree.place(x.astype(float))
        assert cell.min() >= 0 and cell.max() < len(tree.centres) <= 12
        assert len(set(cell[(x == x[0]).all(axis=1)])) == 1
    assert len(vectors.Cells(x[:200], 12).centres) >= 6


def test_one_vector_of_a_third_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SHARD_ROWS", 100)
    monkeypatch.setattr(vectors, "QUERY_ROWS", 10)
    x = clustered(1500)
    x[::3] = x[0]
    assert sorted(map(tuple, topk.inner_products(frame(spark, x), 50, 5).collect())) == brute_topk(x, 50, 5)


def test_huge_components_are_exact_or_refused(spark):
    big = spark.createDataFrame([(i, [1e6 + i, -2e6, float(i)]) for i in range(60)], "vec_id long, embedding array<double>")
    rows = topk.inner_products(big, 50, 5).collect()
    want = sorted(((-sum(int(256 * a) * int(256 * b) for a, b in zip([1e6, -2e6, 0.0], [1e6 + j, -2e6, float(j)])), j) for j in range(1, 60)))[:5]
    assert [(r.vec_id, r.score) for r in rows if r.query_id == 0] == [(j, -s) for s, j in want]
    with pytest.raises(Exception, match="does not fit"):
        topk.inner_products(spark.createDataFrame([(0, [1e30]), (1, [1e30])], "vec_id long, embedding array<double>"), 50, 5).collect()


ODD = [
    (0, [1.0, 0.0], 0), (100, None, 0), (200, [], 0), (300, [float("nan"), 1.0], 0), (400, [None, 1.0], 0), (500, [float("inf"), 0.0], 0),
    (600, [0.0, 0.0], 0), (7, [1.0, 0.0], 0), (8, [0.5, 0.5], 0), (9, [1.0, 0.0, 0.0], 0), (None, [1.0, 0.0], 0), (7, [1.0, 0.0], 0), (700, [2.0], 0),
]


def test_edges(spark):
    df = spark.createDataFrame(ODD, ROWS).withColumns({c: F.lit("x") for c in ("id", "v", "dim", "shard", "score", "rank")})
    got = sorted(map(tuple, topk.inner_products(df, 50, 5).collect()))
    assert got == [(0, 1, 7, 65536), (0, 2, 8, 32768), (0, 3, 600, 0), (600, 1, 0, 0), (600, 2, 7, 0), (600, 3, 8, 0)]
    got = sorted(map(tuple, ann.nearest(df, 100, 10).collect()))
    assert got == [(0, 1, 7, 0.0), (0, 2, 8, 0.5**0.5)]
    assert topk.inner_products(df.limit(0), 50, 5).count() == 0 and ann.nearest(df.limit(0), 100, 10).count() == 0


def recall(spark, x, every, k):
    rows = ann.nearest(frame(spark, x), every, k).collect()
    y, hits, total = x.astype(float), 0, 0
    for i in range(0, len(x), every):
        d = np.sqrt(((y - y[i]) ** 2).sum(axis=1))
        d[i] = np.inf
        mine = sorted((r.rank, r.vec_id, r.score) for r in rows if r.query_id == i)
        assert [m[0] for m in mine] == list(range(1, k + 1))
        assert all(np.isclose(s, d[j], rtol=1e-12) for _, j, s in mine)
        assert [m[1:] for m in mine] == [(j, s) for _, s, j in sorted((r, s, j) for r, j, s in mine)]
        limit = np.sort(d)[k - 1]
        hits += sum(s <= limit for _, _, s in mine)
        total += k
    return hits / total


@pytest.mark.parametrize("shard_rows", [100_000, 500])
def test_recall(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(vectors, "SHARD_ROWS", shard_rows)
    assert recall(spark, clustered(3000, 32), 100, 10) >= 0.95


def test_recall_on_the_embeddings(spark):
    x = np.array([r[0] for r in spark.read.parquet(f"{SF1}/embeddings.parquet").orderBy("vec_id").select("embedding").collect()], dtype=np.float32)
    assert recall(spark, x, 100, 10) >= 0.95


def test_the_test_stops_early():
    x = clustered(6000, 32, 3).astype(float)
    ids = np.arange(6000)
    *_, verified = ann.search_leaves(ids, x, ids[:50], x[:50], None, 10)
    assert verified < 0.8 * 50 * 6000
    number, found, _, every = ann.search_leaves(ids, x, ids[:50], x[:50], None, 10, confidence=1.0)
    assert every == 50 * 6000 and len(found) == 500


def test_chi_square():
    rng = np.random.default_rng(1)
    x = (rng.standard_normal((200_000, 8)) ** 2).sum(axis=1)
    for p in (0.1, 0.5, 0.99):
        assert abs((x < ann.chi_square_at(p, 8)).mean() - p) < 0.005


def test_topk_against_duckdb(spark):
    got = QUERIES["op3_topk"](spark, SF01)
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from read_parquet('{SF01}/embeddings.parquet')")
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(f"select {', '.join(got.columns)} from ({SQL['op3_topk']})").fetchall())
