import random

import pytest
from pyspark.sql import functions as F

from larder.operators.chunked import forward_fill, preceding_rows
from larder.operators.star import dense_key


@pytest.mark.parametrize("chunk_rows", [1, 3, 7, 1000])
def test_forward_fill_over_chunks(spark, chunk_rows):
    rng = random.Random(3)
    rows = [(k, i * rng.choice([1, 2]) + 40 * k, rng.choice([None, None, None, f"v{i}"])) for k in range(3) for i in range(60)]
    rows = [(k, o, v) for (k, o), v in {(k, o): v for k, o, v in rows}.items()]
    df = spark.createDataFrame(rows, "k int, o long, v string")
    got = {(r.k, r.o): r.f for r in forward_fill(df, "v", "o", "f", ["k"], chunk_rows).collect()}
    expected, last = {}, {}
    for k, o, v in sorted(rows):
        last[k] = v if v is not None else last.get(k)
        expected[k, o] = last[k]
    assert got == expected


def test_forward_fill_without_key(spark):
    df = spark.createDataFrame([(0, None), (5, "a"), (6, None), (70, None), (71, "b"), (90, None)], "o long, v string")
    got = {r.o: r.f for r in forward_fill(df, "v", "o", "f", chunk_rows=10).collect()}
    assert got == {0: None, 5: "a", 6: "a", 70: "a", 71: "b", 90: "b"}


@pytest.mark.parametrize("chunk_rows", [1, 2, 5, 1000])
def test_preceding_rows_over_chunks(spark, chunk_rows):
    rng = random.Random(5)
    rows = [(k, o, f"{k}-{o}") for k in range(4) for o in sorted(rng.sample(range(200), 40 if k else 3))]
    df = spark.createDataFrame(rows, "k int, o long, t string")
    got = {(r.k, r.o): [x.t for x in r.h] for r in preceding_rows(df, 6, "o", ["t"], "h", ["k"], chunk_rows).collect()}
    expected = {}
    for key in range(4):
        mine = [r for r in rows if r[0] == key]
        for i, (k, o, _) in enumerate(mine):
            expected[k, o] = [t for _, _, t in mine[max(0, i - 6) : i]]
    assert got == expected


def test_dense_key_over_partitions(spark):
    names = [f"n{i % 97:03d}x{i}" for i in range(500)]
    df = spark.createDataFrame([(n,) for n in names], "name string").repartition(7)
    got = {r["name"]: r.id for r in dense_key(df, ["name"], "id").collect()}
    assert got == {n: i + 1 for i, n in enumerate(sorted(names))}
    assert dense_key(df.filter(F.lit(False)), ["name"], "id").count() == 0


def test_sparse_order_has_few_chunks(spark):
    from larder.operators.chunked import _chunk

    df = spark.range(1000).select((F.col("id") * 1_000_000 + 17).alias("o"), F.when(F.col("id") % 300 == 5, F.col("id").cast("string")).alias("v"))
    assert df.select(_chunk(df, "o", 100).alias("c")).distinct().count() <= 12
    got = {r.o: r.f for r in forward_fill(df, "v", "o", "f", chunk_rows=100).collect()}
    assert got == {i * 1_000_000 + 17: (str((i - 5) // 300 * 300 + 5) if i >= 5 else None) for i in range(1000)}
