import base64
import hashlib
import random
import time

import numpy as np
import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from sessionlake.llm import byte_bpe

with open(byte_bpe.RANKS, "rb") as f:
    LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text(alphabet="aeht 's\n.é1", max_size=60), st.text(alphabet="a \n\t\x0b\x0c\r\x1c\x85\xa0\u2003\x00.", max_size=30)), max_size=5))
def test_as_the_library(texts):
    texts = [t.encode(errors="replace").decode() for t in texts]
    ids = byte_bpe.codec().encode([t.encode() for t in texts])
    assert [x.tolist() for x in ids] == [LIBRARY.encode_ordinary(t) for t in texts]
    assert [byte_bpe.codec().decode(x.tobytes()).decode() for x in ids] == texts


def test_long_pre_tokens():
    rng = random.Random(2)
    for text in ("a" * 20_000, "".join(rng.choice("thein") for _ in range(30_000)), "é" * 3000, "." * 5001, " " * 4000):
        began = time.time()
        assert byte_bpe.ByteBPE().merge([text.encode()])[0] == LIBRARY._encode_single_piece(text.encode())
        assert time.time() - began < 5


def test_rows(spark):
    rows = [(1, "The end. don't", 0), (2, None, 0), (3, "", 0), (None, "x\r\n  y", 0), (1, "The end. don't", 1), (4, "über " * 5000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for k, t, _ in rows:
        ids = LIBRARY.encode_ordinary(t or "")
        want.append((k, len(ids), sha(np.array(ids, "<u4").tobytes()), sha((t or "").encode())))
    assert sorted(map(tuple, byte_bpe.digests(docs).collect()), key=str) == sorted(want, key=str)
    back = byte_bpe.decode(byte_bpe.encode(docs)).collect()
    assert sorted(((r.doc_id, bytes(r.data).decode()) for r in back), key=str) == sorted(((k, t or "") for k, t, _ in rows), key=str)
    assert byte_bpe.digests(docs.filter("false")).count() == 0
