"""Hard negatives against brute force in Python integers, and the cases of the docstring."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfield.llm import negatives as N

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, every=50):
    """(vec_id, vector, label) rows, ids may repeat; the answer as sorted tuples."""
    part = [r for r in rows if None not in (r[0], r[1], r[2]) and all(x is not None and math.isfinite(x) for x in r[1])]
    part = [(i, [math.floor(256 * x) for x in v], c) for i, v, c in part]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a_id, a, label in part:
        if a_id % every:
            continue
        rated = sorted((-dot(a, v), i, c) for i, v, c in part)
        for score, p_id, _ in [r for r in rated if r[2] == label and r[1] != a_id][:5]:
            ps = -score
            good = [(n, -s) for s, n, c in rated if c != label and 50 * ps <= 100 * -s <= 95 * ps][:3]
            out += [(a_id, p_id, k + 1, n, ps, s) for k, (n, s) in enumerate(good)]
    return sorted(out)


def run(spark, rows, **options):
    return sorted(map(tuple, N.hard_negatives(spark.createDataFrame(rows, SCHEMA), **options).collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=8)
    # A hot vector, ties, near vectors, negative scores and few labels.
    rows = [(i, (base + rng.normal(size=8) * rng.choice([0, 0.1, 0.6, 3])).tolist(), int(rng.integers(0, 3))) for i in range(220)]
    want = brute(rows, 10)
    assert want
    assert run(spark, rows, every=10) == want
    assert run(spark, rows, every=10, cells=1) == want
    assert run(spark, rows, every=10, cell_rows=7) == want


def test_hot_vector_of_a_third_of_the_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [1.0, 2.0, 0.5] if i % 3 == 0 else rng.normal(size=3).tolist(), i % 4) for i in range(150)]
    assert run(spark, rows, every=30) == brute(rows, 30)


def test_odd_rows(spark):
    ok = [(i, [1.0 + i / 100, 0.5], i % 2) for i in range(0, 60, 5)]
    odd = [(None, [1.0, 1.0], 0), (51, None, 0), (52, [1.0, None], 1), (53, [float("nan"), 1.0], 1), (54, [float("inf"), 1.0], 0), (55, [1.0, 1.0], None)]
    assert run(spark, ok + odd) == brute(ok)
    assert run(spark, []) == [] == run(spark, odd)
    # Repeated rows count by themselves; shorter and empty vectors end in zeros.
    again = ok + ok[:4] + [(57, [1.2], 1), (58, [], 0), (59, [0.7, 0.2, 9.0], 1)]
    assert run(spark, again) == brute(again)
    # An anchor without positives, and without others at all.
    assert run(spark, [(0, [1.0], 0), (1, [1.0], 1)]) == [] == run(spark, [(0, [1.0], 0)])


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=4) * 1e6 + 2e6).tolist(), i % 2) for i in range(60)]
    assert run(spark, rows, every=20) == brute(rows, 20)
    wide = [(i, [1e300, float(i)], i % 2) for i in range(8)]
    assert all(r[5] <= N.WIDEST for r in run(spark, wide, every=4))


def test_clashing_columns(spark):
    rows = [(i, [1.0 + i / 100, 0.5], i % 2) for i in range(0, 60, 5)]
    df = spark.createDataFrame(rows, SCHEMA)
    names = ("row", "cell", "q", "slot", "score", "positives", "low", "high", "n", "v")
    crowded = df.select("*", *[F.lit("x").alias(n) for n in names])
    assert sorted(map(tuple, N.hard_negatives(crowded).collect())) == brute(rows)


def test_products_and_order():
    a = np.array([[2**40, 3], [-(2**40), 1]])
    assert N.products(a, a).tolist() == [[N.WIDEST, -N.WIDEST], [-N.WIDEST, N.WIDEST]]
    group, score, place = np.array([1, 0, 1, 1]), np.array([5, 1, 7, 7]), np.array([0, 1, 3, 2])
    for bound in (10, 2**61):
        assert [x.tolist() for x in N.leading(group, score, place, 2, 2, bound, 4)] == [[0, 1, 1], [1, 7, 7], [1, 2, 3]]
