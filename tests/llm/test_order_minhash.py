import inspect
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sessionlake.llm import order_minhash as om


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=16), st.lists(st.integers(0, 4), max_size=16), st.integers(0, 16))
def test_banded_distance(a, b, most):
    assert om.distance(np.array(a, np.uint32), np.array(b, np.uint32), most) == min(edit(a, b), most + 1)


def test_sketch_follows_order():
    seed, words = om.seeds(64), np.arange(60, dtype=np.uint32)
    swapped = np.concatenate([words[30:], words[:30]])
    same = lambda x, y: (om.sketch(x, seed, 2) == om.sketch(y, seed, 2)).mean()
    assert same(words, words) == 1 and same(words, swapped) < 0.6
    assert same(words, np.where(words == 20, 99, words)) > 0.6
    assert len(om.sketch(words[:0], seed, 2)) == 0 and same(words[:3], words[:3]) == 1
    by_one = np.concatenate([om.sketch(np.repeat(words, 4000), seed[i : i + 1], 2) for i in range(3)])
    assert (by_one == om.sketch(np.repeat(words, 4000), seed, 2)[:3]).all()


def test_classes(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randrange(40, 160))] for _ in range(60)]
    rows = [(i, " ".join(w), 0) for i, w in enumerate(base)]
    for i in range(0, 60, 2):  # near copies of the even ones, in chains
        w = list(base[i])
        for n in range(3):
            w[rng.randrange(len(w))] = "changed"
            rows.append((100 + 10 * i + n, " ".join(w), 0))
    rows += [(1, rows[1][1], 0), (900, rows[1][1].upper(), 0), (901, None, 0), (902, "", 0), (None, rows[3][1], 0), (903, "two words", 0), (904, "two  words", 0), (905, "x " * 9000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node int").repartition(3)
    got = om.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    words = [(t or "").lower().split() for _, t, _ in rows]
    parent = list(range(len(rows)))
    find = lambda x: x if parent[x] == x else find(parent[x])
    for i in range(len(rows) - 1):
        for j in range(i):
            if words[i] == words[j] or abs(len(words[i]) - len(words[j])) < 40 and len(set(words[i]) & set(words[j])) > 20 and edit(words[i], words[j]) <= 0.2 * max(len(words[i]), len(words[j])):
                parent[find(i)] = find(j)
    want = {}
    for i, (k, _, _) in enumerate(rows):
        want.setdefault(find(i), []).append(k)
    smallest = lambda keys: min((k for k in keys if k is not None), default=None)
    found = {}
    for r in got:
        found.setdefault(r.class_id, []).append(r.doc_id)
    order = lambda keys: sorted(keys, key=lambda k: -1 if k is None else k)
    assert {k: order(v) for k, v in found.items()} == {smallest(v): order(v) for v in want.values()}
    assert om.near_duplicates(docs.filter("false")).count() == 0


def test_mixed_bucket(spark):
    """Texts around one common passage, similar in pairs only: stars meet some of these, the last round the rest."""
    rng, rows = random.Random(6), []
    common = [f"c{i}" for i in range(30)]
    for i in range(12):
        own = common + [f"u{i}x{j}" for j in range(25)]
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join(own[:-2] + ["end"]))]
    got = om.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), stars=1).collect()
    assert all(r.class_id == r.doc_id // 2 * 2 for r in got) and rng


def test_banded_distance_of_long_texts():
    rng = random.Random(8)
    for n in (60, 150, 300):
        a = [rng.randrange(50) for _ in range(n)]
        for edits in (3, 15, 40):
            b = list(a)
            for _ in range(edits):
                i = rng.randrange(len(b))
                b[i : i + rng.randrange(2)] = [rng.randrange(50)] * rng.randrange(2)
            true = edit(a, b)
            for most in (true - 1, true, true + 30):
                assert om.distance(np.array(a, np.uint32), np.array(b, np.uint32), most) == min(true, most + 1)


def test_long_common_passage(spark):
    """Pairs of copies around one passage, which meet in buckets that all others share: more than stars reach."""
    rng, rows = random.Random(9), []
    common = [f"c{i}" for i in range(80)]
    for i in range(150):
        own = [f"u{i}x{j}" for j in range(30)]
        copy = [f"v{i}x{j}" if j in set(rng.sample(range(30), 10)) else w for j, w in enumerate(own)]
        rows += [(2 * i, " ".join(own[:15] + common + own[15:])), (2 * i + 1, " ".join(copy[:15] + common + copy[15:]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = [i for i in range(300) if edit(rows[i // 2 * 2][1].split(), rows[i // 2 * 2 + 1][1].split()) <= 22]
    got = {r.doc_id: r.class_id for r in om.near_duplicates(docs).collect()}
    assert len(want) > 250 and got == {i: i // 2 * 2 if i in set(want) else i for i in range(300)}


def test_blocks_hold_every_pair(spark):
    """Two buckets of the same 50 in stripes of 4: each link of different classes once, those of long texts still to be verified."""
    rng = np.random.default_rng(2)
    texts = [rng.integers(0, 1000, 40 + i % 3 * 10).astype(np.uint32) for i in range(25)]
    texts += [np.where(np.arange(len(w)) < 3, 5000, w).astype(np.uint32) for w in texts]
    open_ = spark.createDataFrame([(b, i, len(w), 50, i // 2) for i, w in enumerate(texts) for b in (1, 2)], "bucket long, node long, n_words int, size long, comp long")
    rows = spark.createDataFrame([(i, bytearray(om.bag(w)), bytearray(w.astype("<u4").tobytes())) for i, w in enumerate(texts)], "node long, bag binary, words binary")
    got = om.remaining(open_, rows, 0.8, 4, 55).collect()
    assert sorted((r.a, r.b) for r in got) == [(i, i + 25) for i in range(25)]
    assert all(r.similarity is None if len(texts[r.a]) > 55 else abs(r.similarity - 1 + 3 / len(texts[r.a])) < 1e-9 for r in got)


def test_blocks_skip_joined_classes():
    """Four like texts of as many classes: three links join them."""
    word = np.arange(30, dtype="<u4").tobytes()
    i, j = np.triu_indices(4, 1)
    got = list(om.joined(i.tolist(), j.tolist(), [1, 2, 3, 4], [word] * 4, [{5, 9}] * 4, 5, 0.8))
    assert [(p, q) for p, q, _ in got] == [(0, 1), (0, 2), (0, 3)] and not list(om.joined([0], [1], [1, 2], [word] * 2, [{5, 9}] * 2, 9, 0.8))


def test_candidates_at_the_limit():
    """The share of pairs of a given edit similarity, by brute force, that near_duplicates() makes candidates."""
    defaults = {k: v.default for k, v in inspect.signature(om.near_duplicates).parameters.items()}
    rng, seed = random.Random(12), om.seeds(defaults["sketches"])
    for similarity, least in ((0.8, 0.95), (0.85, 0.98), (0.9, 0.99)):
        found = []
        for _ in range(150):
            a = [rng.randrange(1 << 30) for _ in range(100)]
            b = list(a)
            for _ in range(round((1 - similarity) * 100)):
                i, (gone, come) = rng.randrange(len(b)), rng.choice([(0, 1), (1, 0), (1, 1)])
                b[i : i + gone] = [rng.randrange(1 << 30)] * come
            if similarity <= 1 - edit(a, b) / max(len(a), len(b)) <= similarity + 0.03:
                found.append((om.sketch(np.array(a, np.uint32), seed, defaults["width"]) == om.sketch(np.array(b, np.uint32), seed, defaults["width"])).any())
        print(similarity, len(found), np.mean(found))
        assert len(found) > 60 and np.mean(found) >= least
