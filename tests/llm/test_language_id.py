import itertools
import math

import numpy as np

from sessionlake.llm import language_id as li


def brute(voc, word, logp):
    """Sum over every way to cut the word."""
    w, total = li.START + word, 0.0
    for cuts in itertools.product([0, 1], repeat=len(w) - 1):
        at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(w)]
        p = 1.0
        for a, b in zip(at, at[1:]):
            k = voc.ids.get(w[a:b])
            p *= math.exp(logp[k] if k is not None else li.UNKNOWN if b - a == 1 else -math.inf)
        total += p
    return math.log(total)


def test_forward_sums_all_segmentations():
    voc = li.pieces(li.PIECE_MODEL)
    rng = np.random.default_rng(3)
    logp = np.log(rng.dirichlet(np.ones(voc.size)))
    logp = np.append(logp, [li.UNKNOWN, -np.inf])
    words = ["the", "elle", "straße", "a", "ñandú", "\U00010348x"]
    assert np.allclose(voc.score(words, logp[:, None])[:, 0], [brute(voc, w, logp) for w in words])
    uses = voc.expected(["the", "elle"], np.array([2.0, 1.0]), logp)
    for k in ("th", "the", "l"):  # the derivative of the log probability by a piece's
        i, up = voc.ids[k], logp.copy()
        up[i] += 1e-5
        slope = sum(n * (brute(voc, w, up) - brute(voc, w, logp)) / 1e-5 for w, n in (("the", 2), ("elle", 1)))
        assert abs(uses[i] - slope) < 1e-3


def test_long_word_is_finite():
    voc = li.pieces(li.PIECE_MODEL)
    logp = np.append(np.full(voc.size, -10.0), [li.UNKNOWN, -np.inf])
    assert np.isfinite(voc.score(["ab" * 4000], logp[:, None])).all()


def test_prediction(spark):
    own = {"en": "the house and the garden with this thing of that other people", "de": "der Garten und das Haus mit nicht einer Straße für die Leute", "fr": "la maison et le jardin avec une chose des autres gens était"}
    rows = [(i, " ".join(np.random.default_rng(i).permutation(t.split())), lang, "s") for i in range(120) for lang, t in [list(own.items())[i % 3]]]
    rows += [(500, None, "en", "s"), (501, "", "en", "s"), (502, "123 ### 4_5", "fr", "s"), (503, "THE GARDEN!! and people", None, "s"), (None, "das Haus, der Garten", "en", "s"), (503, "THE GARDEN!! and people", None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string").repartition(3)
    got = li.predict(docs, li.learn(docs)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == ["en", "de", "fr"][i % 3] and 0 < by[i].score <= 1 for i in range(120))
    assert [(by[i].lang_pred, by[i].score) for i in (500, 501, 502)] == [("und", 0)] * 3
    assert by[503].lang_pred == "en" and by[None].lang_pred == "de"


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in li.predict(docs, li.learn(docs)).collect()] == [("und", 0.0)]
    assert li.predict(docs.filter("false"), li.learn(docs)).count() == 0


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = li.query(spark, "/root/testdata/sf0.01").filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(found) > 100 and sum(r.lang_pred == r.lang for r in found) >= 0.97 * len(found)
