import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sessionlake.llm import framed_records as fr
from sessionlake.llm import word_encoder
from sessionlake.llm.common import scratch
from sessionlake.llm.word_encoder import WORD_BPE, WordEncoder, encoder

LETTER = str.maketrans("0123456789", "ghijklmnop")
LIBRARY = Tokenizer.from_file(WORD_BPE)
TEXTS = ["", None, "Étion dans, l'été  the end", "<|endoftext|> don't\tSTOP\r\nHello HELLO", "é H̱ İI ΣΣ ẖ", "word " * 30_000, "x" * 5000, "a b \x1c c"]


def test_crc32c_known_values():
    unmask = lambda x: (((int(x) - 0xA282EAD8) & 0xFFFFFFFF) >> 17 | ((int(x) - 0xA282EAD8) & 0xFFFFFFFF) << 15) & 0xFFFFFFFF
    long = bytes(range(256)) * 9
    assert [hex(unmask(x)) for x in fr.masked_crc32c([b"123456789", b"\0" * 32, b"\xff" * 32])] == ["0xe3069283", "0x8a9136aa", "0x62a8ab43"]
    assert fr.masked_crc32c([long, long[:-1] + b"!"])[0] != fr.masked_crc32c([long[:-1] + b"!"])[0]

    def plain(data):
        crc = 0xFFFFFFFF
        for b in data:
            crc ^= b
            for _ in range(8):
                crc = crc >> 1 ^ (0x82F63B78 if crc & 1 else 0)
        return crc ^ 0xFFFFFFFF

    for n in (4, 511, 512, 513, 1024, 2300):
        assert unmask(fr.masked_crc32c([b"abcd", long[:n]])[1]) == plain(long[:n])


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_words_encode_as_whole_text(text):
    assert encoder().encode([text.encode(errors="replace")])[0].tolist() == LIBRARY.encode(text.encode(errors="replace").decode(), add_special_tokens=False).ids


def test_every_code_point_and_what_follows():
    """Words with each code point to U+3000 and each sixteenth later inside, alone and in capitals, and plain words after them: one encoder that forgets nothing."""
    own = WordEncoder()
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000 and (i < 0x3000 or i % 16 == 3)]
    for i in range(0, len(points), 4096):
        some = points[i : i + 4096]
        texts = [" ".join(some), " ".join(f"a{c}B" for c in some), " ".join(f"q{i + j:x}".translate(LETTER) for j in range(40))]
        for text, ids in zip(texts, own.encode([t.encode() for t in texts])):
            assert ids.tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_batches_after_odd_words():
    odd = ["\u0130", "\u0130stanbul", "<|endoftext|>", "x<|startoftext|>Y", "<|EndOfText|>", "\x01", "a\x01b", "e\u0301", "\u1e9e", "\ufb01n", "don't", "x'S", "<|", "\u01c5", "\u03a3\u03a3"]
    rng, own = random.Random(3), WordEncoder()
    for _ in range(400):
        texts = [" ".join(rng.choice(odd) if rng.random() < 0.2 else "".join(rng.choice("abcdeABC") for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(12))) for _ in range(25)]
        for text, ids in zip(texts, own.encode([t.encode() for t in texts])):
            assert ids.tolist() == LIBRARY.encode(text, add_special_tokens=False).ids, text


def test_a_word_of_another_form(monkeypatch):
    """Should a class of words hold one that splits, each of the batch is encoded by itself."""
    monkeypatch.setattr(word_encoder, "LETTERS", word_encoder.LATIN)
    text = "don't a1b plain \u0130"
    assert WordEncoder().encode([text.encode()])[0].tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_round_trip(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(None, "null key", "x", 2), (3, "again", "x", 3), (3, "again", "x", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string, n_tokens int")
    manifest = fr.write(docs, scratch(spark, "t"), shards=3)
    found = sorted(fr.read(manifest).collect(), key=lambda r: r.start)
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert [r.key for r in found] == [r[0] for r in want]
    at = 0
    for r, w in zip(found, want):
        ids = LIBRARY.encode(w[1] or "", add_special_tokens=False).ids + [2]
        data = np.array(ids, "<u4").tobytes()
        assert (r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) == (at, len(ids), zlib.crc32(data), data)
        at += len(ids)
    shard = max(manifest.collect(), key=lambda m: m.records)
    one = fr.fetch(shard.file, [1, 0])
    assert len(one) == 2 and [k for k, _ in one] == [k for k, _ in fr.fetch(shard.file, [0, 1])][::-1]


def test_damage_is_found():
    data = fr.frame([7, None], [np.array([1, 70000]), np.array([], np.int64)])
    assert [(k, x.tolist()) for k, x in fr.unframe(b"".join(data))] == [(7, [1, 70000]), (None, [])]
    for i in range(len(data[0])):
        bad = bytearray(data[0])
        bad[i] ^= 1
        with pytest.raises(ValueError):
            fr.unframe(bytes(bad))
    with pytest.raises(ValueError):
        fr.unframe(data[0][:-1])


def test_empty_table(spark):
    assert fr.read(fr.write(spark.createDataFrame([], "doc_id long, text string"), scratch(spark, "t"))).count() == 0
