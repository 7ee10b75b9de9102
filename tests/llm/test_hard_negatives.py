import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionlake.llm import hard_negatives as hn

NAN, INF = float("nan"), float("inf")


def brute(rows, asked, k, positives=5):
    """Plain loops, every window by itself; rows: (vec_id, label, vector)."""
    own = [(i, lab, [math.floor(256 * c) for c in v]) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for a, label, x in own:
        if not asked(a):
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y)), i, lab) for i, lab, y in own if i != a)
        for s, p, _ in [r for r in scored if r[2] == label][:positives]:
            fits = [r for r in scored if r[2] != label and 30 * -s <= 100 * -r[0] <= 90 * -s][:k]
            out += [(a, p, n + 1, r[1], -s, -r[0]) for n, r in enumerate(fits)]
    return sorted(out)


def run(df, asked, **more):
    return sorted(tuple(r) for r in hn.mine(df, asked, **more).collect())


@pytest.mark.parametrize("blocks", [(8192, 512), (17, 3)])
def test_equal_to_plain_loops(spark, blocks):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(240, 3)), 1)
    x[60:140] = x[0]  # copies, and with them ties
    rows = [(i, int(rng.integers(0, 3)), v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(3)
    rows = [(r.vec_id, r.label, r.embedding) for r in df.collect()]
    got = run(df, F.col("vec_id") % 7 == 0, block=blocks[0], anchor_block=blocks[1], k=4)
    assert got == brute(rows, lambda i: i % 7 == 0, 4) and len(got) > 100


def test_odd_rows(spark):
    v = [1.0, 0.5]
    rows = [(0, 1, v, 5), (100, 1, v, 5), (1, 1, v, 5), (2, 2, [0.6, 0.5], 5), (2, 2, [0.6, 0.5], 5), (3, None, v, 5), (None, 1, v, 5), (4, 2, None, 5), (5, 2, [NAN, 1.0], 5), (6, 2, [INF, 1.0], 5), (7, 2, [None, 1.0], 5), (8, 2, [], 5), (9, 3, [-1.0, 0.2], 5), (200, 9, [0.3, 0.2], 5)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>, score int")
    got = run(df, F.col("vec_id") % 100 == 0)
    assert got == brute([r[:3] for r in rows if r[2] != []], lambda i: i % 100 == 0, 10)
    assert [r[3] for r in got if r[:2] == (0, 1)] == [2, 2, 200]
    assert run(df.filter("false"), F.col("vec_id") % 100 == 0) == [] and run(df, F.lit(False)) == []


def test_negative_and_zero_scores(spark):
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [-1.0, 0.0]), (2, 1, [0.0, 1.0]), (3, 2, [0.0, 5.0]), (4, 2, [-0.5, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert run(df, F.col("vec_id") == 0) == [(0, 2, 1, 3, 0, 0)] == brute(rows, lambda i: i == 0, 10)


def test_slots_by_hand():
    at, col = hn.first_of_rows(np.array([[5, 7, 7, 1], [1, 1, 1, 1]]), np.array([[True, True, True, True], [False, True, True, True]]), 2)
    assert list(zip(at.tolist(), col.tolist())) == [(0, 1), (0, 2), (1, 1), (1, 2)]
    big = np.array([[1 << 24, 3]])
    assert hn.products(big, big).tolist() == [[(1 << 48) + 9]] and hn.products(np.array([[1 << 30, 1]]), np.array([[1 << 30, 1]])).tolist() == [[(1 << 60) + 1]]
