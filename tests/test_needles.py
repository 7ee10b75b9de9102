from hypothesis import given, settings
from hypothesis import strategies as st

from sessionlake.operators import needles


def plain(text, wanted):
    return sorted((n, i, text[:i].count("\n"), i - text.rfind("\n", 0, i) - 1) for n in wanted for i in range(len(text)) if text.startswith(n, i))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abé\n", max_size=40), st.sets(st.text(alphabet="abé\n", min_size=1, max_size=4), min_size=1, max_size=6))
def test_matches(text, wanted):
    wanted = sorted(wanted)
    found = needles.matches(text, needles.automaton(wanted), wanted)
    assert sorted((wanted[i], *rest) for i, *rest in found) == plain(text, wanted)


def test_blocks_case_nulls_and_repeats(spark):
    texts = spark.createDataFrame([(1, "Aa\nAAB", "x"), (1, "Aa\nAAB", "x"), (2, None, "y"), (None, "ab ΣΑΣ", "z")], "line long, content string, text string").withColumnRenamed("line", "k").repartition(2)
    wanted = spark.createDataFrame([("AA",), ("aa",), ("B",), (None,), ("",), ("σας",), ("nowhere",)], "needle string")
    want = []
    for k, t, x in ((1, "aa\naab", "x"), (1, "aa\naab", "x"), (None, "ab σασ", "z")):
        want += [(k, x, *p) for p in plain(t, ["aa", "b", "σασ"])]
    for most in (1_000_000, 3):
        got = needles.occurrences_of(texts, wanted, most=most)
        assert sorted(map(tuple, got.select("k", "text", "needle", "offset", "line", "column").collect()), key=str) == sorted(want, key=str)
    assert needles.occurrences_of(texts, wanted.filter("false")).count() == 0 and needles.occurrences_of(texts.filter("false"), wanted).count() == 0


def test_matches_leave_in_small_batches(spark, monkeypatch):
    monkeypatch.setattr(needles, "ROWS", 100)
    assert iter(found := needles.matches("ab\na" * 1000, needles.automaton(["a"]), ["a"])) is found  # not a list of all
    texts = spark.createDataFrame([(1, "aab\n" * 500), (2, "x"), (3, "ba" * 300)], "k long, content string").coalesce(1)
    wanted = spark.createDataFrame([("a",), ("aa",), ("b",)], "needle string")
    got = needles.occurrences_of(texts, wanted).collect()
    want = [(k, *p) for k, t in ((1, "aab\n" * 500), (3, "ba" * 300)) for p in plain(t, ["a", "aa", "b"])]
    assert sorted(map(tuple, got)) == sorted(want)
