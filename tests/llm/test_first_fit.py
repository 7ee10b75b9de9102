import itertools
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sessionlake.llm import first_fit
from sessionlake.llm.byte_encoder import BYTE_BPE, ByteEncoder

LIBRARY = Tokenizer.from_file(BYTE_BPE)
WHITE = [
    "a  b\n\nc \n d\te", "<|endoftext|> a <|endoftext|>", "x<|endoftext|>\ny\n", " lead", "trail ", "\n\n", "\n", "", "a\n b", "a \nb", "été  x\x1cy z", "\x00 a b", "I'll don't  we've 's",
    ".\n.\n...  !", "  ", "a" * 5000 + " b", "　a b c", "a <| b", " '", "'s 's", "a 's\n's", "naïve 中文 テスト 123 4567", " x", "x\r\ny", "12 34\n56",
]


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_ids_are_the_librarys():
    enc = ByteEncoder(keep=10)
    for texts in (WHITE, WHITE[::-1], [" ".join(WHITE), "\n".join(WHITE)]):
        for text, got in zip(texts, enc.encode([t.encode() for t in texts])):
            assert got.tolist() == ids_of(text), repr(text)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab1. \n\t'sé 中<|", max_size=30), max_size=4))
def test_any_text(texts):
    enc = test_any_text.enc = getattr(test_any_text, "enc", None) or ByteEncoder()
    assert [x.tolist() for x in enc.encode([t.encode() for t in texts])] == [ids_of(t) for t in texts]


def plain_first_fit(lengths, capacity):
    room, bins = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        b = next((b for b, r in enumerate(room) if r >= lengths[i]), len(room))
        if b == len(room):
            room.append(capacity)
        bins[i] = (b, capacity - room[b])
        room[b] -= lengths[i]
    return [bins[i] for i in range(len(lengths))]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 16), min_size=1, max_size=40))
def test_tree_finds_the_first_bin_and_no_padding_is_left(lengths):
    x = np.array(lengths, np.int64)
    bins, offsets = first_fit.first_fit_decreasing(x, 16)
    assert list(zip(bins.tolist(), offsets.tolist())) == plain_first_fit(lengths, 16)
    pieces = first_fit.filled(x, 16)
    for i, own in itertools.groupby(sorted(pieces), key=lambda p: p[0]):
        at = 0
        for _, a, b, _, _ in own:
            assert a == at < b
            at = b
        assert at == lengths[i]
    assert {p[0] for p in pieces} == set(range(len(lengths)))
    full = 0
    for _, own in itertools.groupby(sorted(pieces, key=lambda p: p[3:]), key=lambda p: p[3]):
        at = 0
        for _, a, b, _, offset in own:
            assert offset == at
            at += b - a
        full += at == 16
        assert at <= 16 and at & (at - 1) == 0
    assert full == sum(lengths) // 16


def test_pack_all_pieces(spark):
    texts = [None, "", "the end", "word  " * 5000, "x" * 30000] + [f"Étion {i} the " * (i % 97 * 5 + 1) for i in range(300)] + ["same text"] * 100
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "null key", "y", 2), (7, "again", "y", 3), ((1 << 60) + 1, "large key", None, None)] + [(9, "copied row " * 9, None, None)] * 200
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset string, grp int").repartition(5)
    got = first_fit.pack(docs, group=60).collect()
    want = {}
    for key, text, *_ in rows:
        ids = np.array([*ids_of(text), 1], "<u4")
        want.setdefault(key, []).append(ids)
    at = {}
    for r in got:
        at.setdefault(r.sequence_id, []).append(r)
    assert len({r.sequence_id >> 32 for r in got}) > 5
    for own in at.values():
        n = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == n
            n += r.length
        assert n == 2048 or n < 2048 and n & (n - 1) == 0
    key = lambda r: (r.doc_id is None, r.doc_id, r.doc_tokens, r.start)
    for (k, n), own in itertools.groupby(sorted(got, key=lambda r: key(r)), key=lambda r: (r.doc_id, r.doc_tokens)):
        same = [ids for ids in want[k] if len(ids) == n]
        own = list(own)
        assert sum(r.length for r in own) == n * len(same)
        assert all(any(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for ids in same) for r in own)
    assert sum(r.length for r in got) == sum(len(ids) for own in want.values() for ids in own)


def test_empty(spark):
    assert first_fit.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_ids_over_two_bytes():
    for ids in ([], [1, 65535], [1, 65536]):
        assert first_fit.large(first_fit.small(np.array(ids, "<u4"))).tolist() == ids
