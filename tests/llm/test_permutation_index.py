import numpy as np

from sessionlake.llm import permutation_index as pi


def brute(rows, asked, k):
    out = {}
    for key, q in asked:
        near = sorted((float(np.sqrt(np.square(np.array(v) - q).sum())), i) for i, v in rows if i != key)
        out[key] = near[:k]
    return out


def test_footrule_by_hand():
    pivots = np.eye(4)
    x = np.array([[4.0, 3, 2, 1], [1, 2, 3, 4], [3, 4, 2, 1]])
    order = pi.nearest_pivots(x, pivots, 2)
    assert order.tolist() == [[0, 1], [3, 2], [1, 0]]
    places = np.full((3, 4), 2, np.int16)
    places[np.arange(3)[:, None], order] = np.arange(2)
    keys, far = pi.ranked(np.array([1, 2, 3]), x, places, 9, x[0], order[0], 2, 2)
    assert keys.tolist() == [1, 3] and np.allclose(far, [0, 2**0.5])
    assert pi.ranked(np.array([1, 2, 3]), x, places, 1, x[0], order[0], 2, 1)[0].tolist() == [3]


def test_recall(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    matrix, keys = np.array([v for _, v in rows]), np.array([i for i, _ in rows])
    got = {}
    for r in pi.query(spark, "/root/testdata/sf0.1").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = 0
    assert sorted(got) == [i for i in sorted(keys.tolist()) if i % 100 == 0]
    for q, found in got.items():
        far = np.sqrt(np.square(matrix - matrix[keys == q][0]).sum(1))
        far[keys == q] = np.inf
        found = sorted(found)
        assert [r for r, _, _ in found] == list(range(1, 11)) and [s for _, _, s in found] == sorted(s for _, _, s in found)
        assert np.allclose([s for _, _, s in found], [far[keys == v][0] for _, v, _ in found])
        hits += len({v for _, v, _ in found} & set(keys[np.lexsort((keys, far))[:10]].tolist()))
    print("recall", hits / len(got) / 10)
    assert hits >= 0.95 * 10 * len(got)


def test_unusable_ties_and_few(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(100, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [0.0, 0.0], 1), (4, None, 1), (5, [nan, 1.0], 1), (6, [inf, 1.0], 1), (7, [None, 1.0], 1), (None, [1.0, 1.0], 1), (200, [0.0, 2.0], 1), (300, None, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    got = sorted((r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in pi.search(df, df.filter("vec_id % 100 = 0")).collect())
    r5 = round(5**0.5, 6)
    assert got == [(100, 1, 1, 0.0), (100, 2, 2, 0.0), (100, 3, 200, r5), (200, 1, 1, r5), (200, 2, 2, r5), (200, 3, 100, r5)]
    assert pi.search(df.filter("false"), df).count() == 0


def test_other_lengths_and_blocks(spark):
    """Vectors of another length are left out; many copies in one file of many blocks; queries in blocks too."""
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(300, 4)), np.ones((200, 4))])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, [1.0, 2.0]), (1100, [1.0] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for r in pi.search(df, df.filter("vec_id % 10 = 0"), k=5, pivots=12, prefix=6, files=12, reads=1.0, share=1.0, block=16, query_block=4).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    own = [(i, v) for i, v in rows if i < 500]
    want = brute(own, [(i, x[i]) for i in range(0, 500, 10)], 5)
    assert sorted(got) == sorted(want)
    for q, found in got.items():
        assert [v for _, v, _ in sorted(found)] == [i for _, i in want[q]]
