import numpy as np
import pytest
from pyspark.sql import functions as F

from pageflow.llm import products

SCHEMA = "vec_id long, embedding array<float>, row int, score string, block long"


def _expected(rows, asked, k):
    scaled = []
    for no, (i, v) in enumerate(rows):
        if v is not None and all(x is not None and np.isfinite(x) for x in v):
            scaled.append((no, i, [int(np.floor(64 * float(np.float32(x)))) for x in v]))
    out = []
    for no, i, v in scaled:
        if i is None or not asked(i):
            continue
        scores = [
            (-sum(a * b for a, b in zip(v, w, strict=True)), j is None, j or 0, j)
            for other, j, w in scaled
            if other != no and len(w) == len(v)
        ]
        best = sorted(scores, key=lambda s: s[:3])[:k]
        out += [(i, r, s[3], -s[0]) for r, s in enumerate(best, 1)]
    return sorted(out, key=str)


def _found(spark, rows, condition, settings=products.ProductSettings()):
    table = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], SCHEMA)
    found = products.top_products(table, condition, settings)
    assert dict(found.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}
    return sorted((tuple(r) for r in found.collect()), key=str)


def _cloud(n=600, size=8, seed=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, size))
    lengths = rng.choice([0.2, 1.0, 1.0, 6.0], size=n)
    points = centres[rng.integers(0, 12, n)] + rng.normal(size=(n, size)) * 0.05
    return [(i, [float(x) for x in p * s]) for i, (p, s) in enumerate(zip(points, lengths, strict=True))]


@pytest.mark.parametrize(
    "settings",
    [
        products.ProductSettings(),
        products.ProductSettings(bucket_rows=16, block_rows=(4, 9), runs=3),
        products.ProductSettings(bucket_rows=40, block_rows=(8, 64), coordinate_share=2.0),
    ],
)
def test_equals_brute_force(spark, settings):
    rows = _cloud() + [(1000 + i, _cloud()[0][1]) for i in range(60)]
    assert _found(spark, rows, F.col("id") % 20 == 0, settings) == _expected(rows, lambda i: i % 20 == 0, 20)


def test_odd_vectors(spark):
    rows = [
        (0, [1.0, 2.0]), (0, [1.0, 2.0]), (20, [0.0, 0.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]),
        (4, [float("inf"), 1.0]), (None, [1.0, 2.0]), (None, None), (40, []), (60, []), (5, [-1.0, -2.0]), (6, [0.01, -0.01]),
        (80, [1.0, 2.0, 3.0]), (100, [3.0e7, 3.0e7]), (7, [2.0e7, -1.0e7]),
    ]
    asked = lambda i: i % 20 == 0
    small = products.ProductSettings(k=4, bucket_rows=2, block_rows=(1, 2))
    assert _found(spark, rows, F.col("id") % 20 == 0, small) == _expected(rows, asked, 4)
    assert _found(spark, rows, F.col("id") % 20 == 0) == _expected(rows, asked, 20)


def test_ends_of_the_range_and_empty_tables(spark):
    rows = [(0, [1e38, 1.0]), (1, [1e38, 1.0]), (2, [-1e38, 1.0])]
    assert _found(spark, rows, F.col("id") == 0) == [(0, 1, 1, 2**63 - 1), (0, 2, 2, -(2**63))]
    assert _found(spark, [], F.col("id") % 20 == 0) == []
    assert _found(spark, _cloud(30), F.col("id") < 0) == []


def test_short_buckets_are_dropped_before_they_move(spark):
    rng = np.random.default_rng(1)
    long = [(i, [float(x) for x in 50 * np.abs(rng.normal(size=6))]) for i in range(64)]
    short = [(1000 + i, [float(x) for x in 0.05 * rng.normal(size=6)]) for i in range(640)]
    settings = products.ProductSettings(bucket_rows=32)
    met = []
    usual = products._streams
    try:
        products._streams = lambda blocks, pairs, buckets: met.append(pairs.count()) or usual(blocks, pairs, buckets)
        assert _found(spark, long + short, F.col("id") < 64, settings) == _expected(long + short, lambda i: i < 64, 20)
    finally:
        products._streams = usual
    assert met[1] < 22 / 2
