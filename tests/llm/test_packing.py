import itertools
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sessionlake.llm import packing
from sessionlake.llm.word_encoder import WORD_BPE

LIBRARY = Tokenizer.from_file(WORD_BPE)


def fewest(lengths, capacity):
    """By trying every assignment."""
    for n in range(1, len(lengths) + 1):
        if any(max(np.bincount(a, lengths)) <= capacity for a in itertools.product(range(n), repeat=len(lengths))):
            return n
    return 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=6))
def test_bound_and_packing_hold(lengths):
    x = np.array(lengths, np.int64)
    bins, offsets = packing.best_fit_decreasing(x, 12)
    used = len(set(bins.tolist()))
    assert packing.lower_bound(x, 12) <= fewest(lengths, 12) <= used
    for b in set(bins.tolist()):
        at = 0
        for o, n in sorted((o, n) for o, n, c in zip(offsets, lengths, bins) if c == b):
            assert o == at
            at += n
        assert at <= 12


def test_bound_sees_large_items():
    assert packing.lower_bound(np.array([7, 7, 7, 6, 6]), 12) == 4 and packing.lower_bound(np.array([5] * 5), 12) == 3


def test_pack_all_pieces(spark):
    texts = [None, "", "the end", "word " * 9000] + [f"Étion {i} the " * (i % 97 * 5 + 1) for i in range(400)] + ["same text"] * 3
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "null key", "y"), (7, "again", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset string").repartition(5)
    found = packing.pack(packing.pieces(docs), part_items=60)
    got = found.collect()
    want = []
    for key, text, _ in rows:
        ids = LIBRARY.encode(text or "", add_special_tokens=False).ids + [1]
        for p, a in enumerate(range(0, len(ids), 4096)):
            own = np.array(ids[a : a + 4096], "<u4").tobytes()
            want.append((key, p, a, len(own) // 4, zlib.crc32(own)))
    order = lambda r: (r[0] or -1, *r[1:])
    assert sorted((tuple(r)[:5] for r in got), key=order) == sorted(want, key=order)
    for _, own in itertools.groupby(sorted(got, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        at = 0
        for r in own:
            assert r.offset == at
            at += r.length
        assert at <= 4096
    used, bound = packing.certificate(found)
    assert found.filter("part_bins < part_bound or part_bound < 1").count() == 0
    assert bound <= used <= bound + 1 and used == len({r.sequence_id for r in got})


def test_empty(spark):
    assert packing.pack(packing.pieces(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def test_exchange_over_several_partitions_takes_no_more_bins(spark):
    """Pieces over a third of a sequence leave gaps in most, so round 1 opens more than a task holds."""
    rng = np.random.default_rng(5)
    rows = [(i, 0, 0, int(n), 0) for i, n in enumerate(rng.integers(30, 70, 900))]
    names = [f.split() for f in packing.PIECES.split(", ")]
    items = packing.save(spark.createDataFrame(rows, "doc_id long, piece int, start long, length int, crc long").toDF(*[n for n, _ in names]).select(*[F.col(n).cast(k) for n, k in names]).repartition(3), "items")
    used = []
    for rounds in range(2):
        got = packing.pack(items, 100, 60, rounds).collect()
        for _, own in itertools.groupby(sorted(got, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
            at = 0
            for r in own:
                assert r.offset == at
                at += r.length
            assert at <= 100
        used.append(len({r.sequence_id for r in got}))
    assert len(got) == 900 and used == sorted(used, reverse=True), used


def test_opened_sequences_stay_whole(spark):
    todo = spark.range(400).selectExpr("id AS item", "id div 4 AS sequence_id")
    spread = lambda number: packing._deal(todo, number, 5).groupBy("sequence_id").agg(F.countDistinct("part").alias("n")).agg(F.max("n")).first()[0]
    assert spread(0) > 1 and spread(1) == spread(2) == 1
    assert packing._deal(todo, 1, 5).select("part").distinct().count() == 5
