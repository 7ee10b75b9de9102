from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sessionlake.llm import token_counts as tc


def brute(text, sections):
    """Tokens and crossing tokens of each section, a character at a time."""
    enc, _ = tc.encoding()
    data, at = text.encode(), 0
    char_of = [i for i, c in enumerate(text) for _ in c.encode()]
    where = {c: k for k, (a, b) in enumerate(sections) for c in range(a, b)}
    n, crossing = Counter(), Counter()
    for t in enc.encode_ordinary(text):
        size = len(enc.decode_single_token_bytes(t))
        chars = set(char_of[at : at + size])
        at += size
        votes = Counter(where[c] for c in chars if c in where)
        best = min(votes, key=lambda k: (-votes[k], k)) if votes else -1
        n[best] += 1
        crossing[best] += best >= 0 and votes[best] < len(chars)
    assert at == len(data)
    return n, crossing


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="ab \n\n.é\U0001f600", max_size=60)), st.lists(st.integers(0, 70), max_size=8, unique=True))
def test_attribution(text, cuts):
    text = text.encode(errors="replace").decode()
    cuts = sorted(min(c, len(text)) for c in cuts)
    own = [(a, b) for a, b in zip(cuts[::2], cuts[1::2])]
    split = [0, *[i + 1 for i, c in enumerate(text) if c == "\n"]]
    every = [(a, b) for a, b in zip(split, [*split[1:], len(text)]) if b > a] or [(0, 0)]
    assert tc.lines(text.encode()).tolist() == [list(x) for x in every]
    for sections in (own, every):
        if not text:
            continue
        at, crossing = tc.attribute(*tc.spans(text.encode()), np.array(sections, np.int64).reshape(-1, 2))
        n, across = brute(text, sections)
        assert Counter(at.tolist()) == n and Counter(at[crossing].tolist()) == +across


def test_rows(spark):
    rows = [(1, "The end.\n\nOf it\n", 0), (2, None, 0), (3, "", 0), (None, "x", 0), (1, "The end.\n\nOf it\n", 0), (5, "word " * 20_000 + "\n" + "é" * 9, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = tc.token_counts(docs).drop("text_hash").collect()
    want = []
    for k, t, _ in rows:
        sections = tc.lines((t or "").encode()).tolist()
        n, crossing = brute(t or "", sections)
        want += [(k, i, a, b, n[i], crossing[i]) for i, (a, b) in enumerate(sections)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    given_ = docs.selectExpr("doc_id", "text", "array(named_struct('start', 4, 'end', 7)) AS parts")
    assert sorted((r.section, r.n_tokens) for r in tc.token_counts(given_.filter("doc_id = 1").limit(1), sections="parts").collect())[1] == (0, 1)
    assert tc.token_counts(docs.filter("false")).count() == 0
