import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sessionlake.llm import vector_codes as vc

NAN, INF = float("nan"), float("inf")


def brute(rows, parts, entries, rounds):
    """Plain Lloyd in Python's integers; rows: (vec_id, label, vector)."""
    own = [(i, lab, [math.floor(256 * c) for c in v]) for i, lab, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    w = len(own[0][2]) // parts
    cut = lambda x: [x[p * w : p * w + w] for p in range(parts)]
    first = sorted(own, key=lambda r: (r[0] is None, r[0], r[2]))[:entries]
    books = [[cut(x)[p] for _, _, x in first] for p in range(parts)]
    dist = lambda a, b: sum((i - j) ** 2 for i, j in zip(a, b))
    assign = lambda: [[min((dist(part, e), k) for k, e in enumerate(books[p])) for p, part in enumerate(cut(x))] for _, _, x in own]
    for _ in range(rounds):
        members = defaultdict(list)
        for (_, _, x), best in zip(own, assign()):
            for p, (_, k) in enumerate(best):
                members[p, k].append(cut(x)[p])
        for (p, k), some in members.items():
            books[p][k] = [sum(c) // len(some) for c in zip(*some)]
    return [(i, lab, [k for _, k in best], [d for d, _ in best]) for (i, lab, _), best in zip(own, assign())], books


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 10**6))
def test_reassignment_is_a_full_scan(seed):
    rng = np.random.default_rng(seed)
    x, old = rng.integers(-3, 4, (40, 2)), rng.integers(-3, 4, (6, 2))
    code, far = vc.nearest(x, old)
    new, moved = old.copy(), rng.random(6) < 0.4
    new[moved] += rng.integers(-2, 3, (moved.sum(), 2))
    moved = (new != old).any(1)
    got, d, compared = vc.reassigned(x, code, far, new, moved)
    want, e = vc.nearest(x, new)
    assert got.tolist() == want.tolist() and d.tolist() == e.tolist()
    assert compared <= x.shape[0] * len(new) and (moved.any() or compared == 0)


@pytest.mark.parametrize("n", [3, 150])
def test_equal_to_plain_lloyd(spark, n):
    rng = np.random.default_rng(n)
    x = np.round(rng.normal(size=(n, 8)), 2)
    x[n // 2 : n // 2 + n // 3] = x[0]
    rows = [(i * 3 % n, int(rng.integers(0, 3)) or None, v.tolist()) for i, v in enumerate(x)]
    rows += [(None, 1, rows[0][2]), ((1 << 60) + 1, 1, rows[0][2]), (1, 1, None), (2, 2, [NAN] * 8), (3, 1, [INF] * 8), (4, 1, [None] * 8), (5, 5, rows[1][2]), (5, 5, rows[1][2])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<double>, code string").repartition(4)
    state, books = vc.compress(df, parts=4, entries=7, rounds=2)
    want, want_books = brute(rows, 4, 7, 2)
    key = lambda r: (r[0] is None, r[0], r[1] or 0, r[2])
    assert sorted([(r.vec_id, r.label, r.code, r.far) for r in state.collect()], key=key) == sorted(want, key=key)
    assert books.tolist() == want_books


def test_digest_and_shape():
    assert vc.digest(np.array([[[1, -2], [3, 4]]])) == hashlib.sha256(b"1,-2,3,4").hexdigest()


def test_empty_other_lengths_and_bad_parts(spark):
    kind = "vec_id long, label int, embedding array<float>"
    state, books = vc.compress(spark.createDataFrame([], kind))
    assert state.count() == 0 and books.size == 0
    df = spark.createDataFrame([(1, 1, [1.0] * 4), (2, 1, [2.0] * 4), (3, 1, [1.0] * 3), (4, 1, [])], kind)
    assert vc.compress(df, parts=2)[0].count() == 2
    with pytest.raises(ValueError):
        vc.compress(df, parts=3)
