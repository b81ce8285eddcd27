import math
import random

import numpy as np
import plain
import pytest
from pyspark.sql import functions as F

from larder.llm import mtree


def table(n, dims, seed, repeated=0):
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(5)]
    rows = [[m + rng.gauss(0, 0.2) for m in rng.choice(middles)] for _ in range(n)]
    rows += [rows[0]] * repeated
    return [(i, v) for i, v in enumerate(rows)]


def whole(rows):
    fine = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    return [(i, [math.floor(1024 * x) for x in v]) for i, v in fine]


def search(spark, rows, every, k=10, routing=8):
    df = spark.createDataFrame([(i, v, "z", "z") for i, v in rows], "vec_id long, embedding array<double>, id string, v string")
    found = mtree.top_k(mtree.whole_vectors(df, "vec_id", "embedding"), F.col("id") % every == 0, k, routing)
    return sorted(map(tuple, found.select("query_id", "rank", "id", "score").collect()), key=repr)


@pytest.mark.parametrize("group", [16, 4096])
def test_all_pairs(spark, monkeypatch, group):
    monkeypatch.setattr(mtree, "GROUP", group)
    rows = table(400, 8, 1, repeated=120)
    assert search(spark, rows, 20) == sorted(plain.best_products(whole(rows), lambda i: i % 20 == 0, 10), key=repr)


def test_odd_vectors(spark):
    rows = table(40, 4, 2) + [(100, None), (120, [1.0, None, 0, 0]), (140, [float("nan")] * 4), (160, [float("inf"), 0, 0, 0])]
    rows += [(180, [0.5, -0.25]), (200, []), (20, [0.1, 0.2, 0.3, 0.4]), (None, [9.0, 9.0, 9.0, 9.0]), (60, [1e6, -1e6, 0.0, 0.0])]
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows]
    assert search(spark, rows, 20, k=5, routing=4) == sorted(plain.best_products(whole(rows), lambda i: i % 20 == 0, 5), key=repr)


def test_products_beyond_long_numbers_are_refused():
    fine = np.array([[2.0**30, 1.0]])
    assert mtree._products(fine, fine).tolist() == [[2**60 + 1]]
    with pytest.raises(OverflowError):
        mtree._products(fine * 4, fine)


def test_few_and_no_vectors(spark):
    assert search(spark, [(0, [1.0, 2.0]), (3, [0.0, 1.0])], 20) == [(0, 1, 3, 2048 * 1024)]
    assert search(spark, [(0, [1.0, 2.0])], 20) == []
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert mtree.top_k(mtree.whole_vectors(df, "vec_id", "embedding"), F.col("id") % 20 == 0).count() == 0


def test_pages_are_pruned():
    rng = np.random.default_rng(1)
    x = np.floor(1024 * np.concatenate([rng.normal(m, 0.05, (640, 4)) for m in (-2, 2)]))
    square = float((x**2).sum(axis=1).max())
    group = mtree.Group(np.arange(len(x)), x, square)
    query = x[:1] + 1
    distance = np.sqrt(np.maximum(0, (query**2).sum() + square - 2 * (x @ query[0])))
    read = []
    real = mtree._products
    try:
        mtree._products = lambda a, b: (read.append(len(b)), real(a, b))[1]
        found = mtree.search_group(group, np.zeros(len(x)), query, np.array([-1]), np.array([np.sort(distance)[9]]), np.array([0.0]), 10)
    finally:
        mtree._products = real
    best = sorted(zip((-(x @ query[0])).astype(int).tolist(), range(len(x)), strict=True))[:10]
    assert sorted((-s, i) for _, i, s in found) == best
    assert sum(read) < 0.8 * len(x)


def test_rows_that_workers_read_do_not_grow_with_groups(spark, monkeypatch):
    """A group stands in one bucket, and queries are sent to buckets by themselves; neither is packed with the other."""
    rows, read = table(3000, 8, 5, repeated=300), []
    kind = type(spark.range(0))
    real = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, *a, **b: (read.append(self), real(self, *a, **b))[1])
    assert search(spark, rows, 300, routing=2) == sorted(plain.best_products(whole(rows), lambda i: i % 300 == 0, 10), key=repr)
    sizes = [F.length(f.name) for f in read[-1].schema if f.dataType.typeName() == "binary"]
    total, most = read[-1].select(F.sum(sum(sizes)), F.max(sum(sizes))).first()
    assert most == 8 * 8 and total <= 8 * 8 * (3300 + 11 * 50)


def test_best_keeps_ties_and_repeated_rows():
    best = mtree.Best(2, 3)
    best.add(np.array([0, 0, 1]), np.array([7, 5, 1]), np.array([4, 4, -9]))
    assert best.least.tolist() == [np.iinfo(np.int64).min] * 2
    best.add(np.array([0, 0, 0]), np.array([6, 5, 9]), np.array([4, 4, 3]))
    assert list(zip(best.place.tolist(), best.ids.tolist(), best.scores.tolist(), strict=True)) == [(0, 5, 4), (0, 5, 4), (0, 6, 4), (1, 1, -9)]
    assert best.least[0] == 4
