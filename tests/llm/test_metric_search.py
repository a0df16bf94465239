"""Exact search by M-trees against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from treeloom.llm import metric_search as ms

SCHEMA = "vec_id long, embedding array<double>, score string"


def brute(rows, modulus, k):
    out = {}
    points = [(i, np.floor(256 * np.array(v)).astype(np.int64)) for i, v in rows]
    for i, q in points:
        if i % modulus == 0:
            out[i] = sorted(((-int(q @ x), j) for j, x in points if j != i))[:k]
    return {i: [(j, -s) for s, j in best] for i, best in out.items()}


@pytest.mark.parametrize("kind", ["spread", "clustered", "copies", "large"])
def test_equals_brute_force(spark, kind):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 8)) * (1e5 if kind == "large" else 1)
    if kind == "clustered":
        x = x * 0.05 + rng.normal(size=(6, 8))[rng.integers(0, 6, 600)] * 3
    if kind == "copies":
        x[100:400] = x[99]
    x[7] = 0
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)]
    others = [(900, None, ""), (950, [float("nan")] * 8, ""), (1000, [1.0], ""), (None, [1.0] * 8, ""), (1050, [None] + [1.0] * 7, ""), (1100, [float("inf")] * 8, "")]
    table = spark.createDataFrame([(*r, "extra") for r in rows] + others, SCHEMA).repartition(3)
    got = ms.top_k(table, F.col("id") % 20 == 0, 5, tree_rows=50, pivots=6, query_block=9, shelf_trees=2).toPandas()
    want = brute(rows, 20, 5)
    assert set(got.query_id) == set(want)
    for q, group in got.groupby("query_id"):
        group = group.sort_values("rank")
        assert group["rank"].tolist() == [1, 2, 3, 4, 5]
        assert list(zip(group.vec_id, group.score)) == want[q]


def test_few_none_and_repeated(spark):
    assert ms.top_k(spark.createDataFrame([], SCHEMA), F.col("id") % 50 == 0, 5).count() == 0
    few = ms.top_k(spark.createDataFrame([(0, [1.0, 0.0], ""), (1, [0.5, 1.0], ""), (1, [0.5, 1.0], "")], SCHEMA), F.col("id") % 50 == 0, 5)
    assert [tuple(r) for r in few.orderBy("rank").collect()] == [(0, 1, 1, 32768), (0, 2, 1, 32768)]
    with pytest.raises(ValueError, match="64 bits"):
        ms.top_k(spark.createDataFrame([(0, [1e9], "")], SCHEMA), F.col("id") % 50 == 0, 5)


def test_tree_covers_its_points():
    rng = np.random.default_rng(5)
    x = rng.integers(-300, 300, (500, 6))
    most = float((x * x).sum(1).max())
    tree = ms.load_tree(np.arange(500), x, most)
    points = ms.lifted(tree.x, most)
    assert sorted(tree.ids.tolist()) == list(range(500)) and np.diff(tree.starts).max() <= ms.PAGE
    for page, (lo, hi) in enumerate(zip(tree.starts[:-1], tree.starts[1:])):
        far = np.sqrt(((points[lo:hi] - points[tree.routers[page]]) ** 2).sum(1))
        assert np.allclose(far, tree.to_page[lo:hi]) and np.isclose(far.max(), tree.radii[page])
    assert np.isclose(np.sqrt(((points - points[tree.root]) ** 2).sum(1)).max(), tree.radius)


def test_bounds_avoid_products():
    rng = np.random.default_rng(6)
    x = (rng.normal(size=(2000, 4)) * 5 + rng.normal(size=(20, 4))[rng.integers(0, 20, 2000)] * 400).astype(np.int64)
    most = float((x * x).sum(1).max())
    tree, done = ms.load_tree(np.arange(2000), x, most), []
    best = ms.Nearest(x[:50], np.arange(50), 5, most, np.full(50, -(1 << 62)), False)
    seen = best._page
    best._page = lambda t, p, rows, far: (done.append(len(rows) * (t.starts[p + 1] - t.starts[p])), seen(t, p, rows, far))
    best.visit(tree, np.arange(50))
    assert sum(done) < 0.5 * 50 * 2000
    for i in range(50):
        mine = best.kept[0] == i
        want = sorted((-int(x[i] @ v), j) for j, v in enumerate(x) if j != i)[:5]
        assert [(-s, j) for s, j in zip(best.kept[2][mine].tolist(), best.kept[1][mine].tolist())] == want
