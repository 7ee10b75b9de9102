import itertools
import random
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sessionlake.llm import language_id, order_minhash, quality
from sessionlake.llm.word_encoder import WORD_BPE


def test_stages(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(300)
    rng = random.Random(1)
    text = " ".join(rng.choice(["the", "of", "and", "thing", "other", "house", f"w{i % 37}"]) for i in range(300))
    near = text.replace(" house", " home", 2)
    odd = [(9001, text, "en", "s", 0), (9002, near, "en", "s", 0), (9003, text, "en", "s", 0), (9004, None, "en", "s", 0), (9005, "12 34 ###", "en", "s", 0), (None, "und das ist nicht mit der Haus die von zu " + text, None, None, 0), (9006, "$$$ ### " * 200 + "the", "en", "s", 0)]
    docs = source.unionByName(spark.createDataFrame(odd, source.schema))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.01")
        out.write.parquet(at := str(tmp_path / name))
        if name != "best_fit_packing":
            assert out.columns == docs.columns
            before = {(r.doc_id, r.text) for r in docs.collect()}
            docs = spark.read.parquet(at)
            assert {(r.doc_id, r.text) for r in docs.collect()} <= before
        seen[name] = {r.doc_id for r in spark.read.parquet(at).select("doc_id").collect()}
    assert not {9004, 9005} & seen["language_id"] and {9001, 9002, 9003} <= seen["language_id"]
    assert 9006 not in seen["quality_rules"] and {9001, 9002, 9003} <= seen["quality_rules"]
    assert {9001, 9002, 9003} & seen["near_dedup"] == {9001}
    assert seen["best_fit_packing"] == seen["near_dedup"]
    assert all(r.n_links == 0 for r in order_minhash.near_duplicates(docs).collect())


def edit(a, b):
    """Edit distance of two lists of words, a row at a time."""
    a, b = (np.unique(np.array(a + b), return_inverse=True)[1][s] for s in (slice(None, len(a)), slice(len(a), None)))
    row = np.arange(len(b) + 1)
    for i, x in enumerate(a, 1):
        best = np.minimum(row[1:] + 1, row[:-1] + (b != x))
        new = np.concatenate([[i], best])
        row = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))  # steps along the row
    return int(row[-1])


def test_run_against_brute_force(spark, tmp_path):
    """All stages of run() over a small table: verdicts a row at a time, all pairs of texts compared, pieces by the library."""
    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rng = random.Random(2)
    rows = [tuple(r) for r in source.collect()]
    long_ = max(rows, key=lambda r: len(r[1] or ""))
    for i in range(40):  # copies of documents, with one word in thirty changed or none
        words = rng.choice([r for r in rows[:150] if r[1]])[1].split(" ")
        rows.append((5000 + i, " ".join(w if rng.random() < 0.97 else "other" for w in words) if i % 2 else " ".join(words), "en", "src1", 0))
    rows += [(6000, " ".join([long_[1]] * 12), "en", "src1", 0), (None, None, None, None, None), (6001, "", "en", "src1", 0), (6002, "1 2 3", "en", "src1", 0), (None, rows[3][1], "en", "src1", 0)]
    spark.createDataFrame(rows, source.schema).repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    said = {(r.doc_id, r.text_hash): r for r in language_id.predict(docs, language_id.learn(docs)).collect()}
    hashed = {(r.doc_id, r.text): r.h for r in docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()}
    kept = [r for r in docs.collect() if (s := said[r.doc_id, hashed[r.doc_id, r.text]]).lang_pred != "und" and s.score >= 0.5]
    good = {(r.doc_id, r.text_hash) for r in quality.judge(quality.statistics(spark.createDataFrame(kept, source.schema))).filter("kept").collect()}
    kept = [r for r in kept if (r.doc_id, hashed[r.doc_id, r.text]) in good]
    words = [r.text.lower().split() for r in kept]
    bags, parent = [Counter(w) for w in words], list(range(len(kept)))
    find = lambda x: x if parent[x] == x else find(parent[x])
    for i in range(len(kept)):
        for j in range(i):
            most = int(0.2 * max(len(words[i]), len(words[j])) + 1e-9)
            if (bags[i] - bags[j]).total() <= most and (bags[j] - bags[i]).total() <= most and edit(words[i], words[j]) <= most:
                parent[find(i)] = find(j)
    best = {}
    for i, r in enumerate(kept):
        rank = (r.doc_id if r.doc_id is not None else 1 << 63, hashed[r.doc_id, r.text])
        if find(i) not in best or rank < best[find(i)][0]:
            best[find(i)] = (rank, r)
    library, want = Tokenizer.from_file(WORD_BPE), []
    for _, r in best.values():
        ids = library.encode(r.text, add_special_tokens=False).ids + [1]
        want += [(r.doc_id, p, a, len(ids[a : a + 4096]), zlib.crc32(np.array(ids[a : a + 4096], "<u4").tobytes())) for p, a in enumerate(range(0, len(ids), 4096))]
    assert len(best) < len(kept) < len(rows)
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    for _, own in itertools.groupby(sorted(got, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        at = 0
        for r in own:
            assert r.offset == at
            at += r.length
        assert at <= 4096


def test_near_dedup_keeps_one_of_each_class(spark):
    """Repeated rows, null keys, keys of two texts, clashing columns; by a broadcast and by a join alike."""
    long_ = [" ".join(f"w{n}x{i}" for i in range(60)) for n in range(3)]
    rows = [(5, long_[0], "a"), (5, long_[0], "a"), (5, long_[1], "b"), (None, long_[0] + " more", "c"), (None, long_[2], "d"), (None, long_[2], "e"), (9, long_[1], "f"), (3, None, "g"), (4, "", "h"), (7, "alone here", "i")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, _key0 int, comp int").repartition(3)
    for most in (2_000_000, 0):
        got = corpus_pipeline.near_dedup_stage(spark, docs, "", most)
        assert got.columns == docs.columns
        kept = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
        assert kept == sorted([(5, long_[0]), (5, long_[1]), (None, long_[2]), (3, None), (7, "alone here")], key=str)
    assert corpus_pipeline.near_dedup_stage(spark, docs.filter("false"), "").count() == 0
