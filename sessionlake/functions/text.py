"""Text as Column expressions: tokens, query terms, snippets, occurrences, places in lines; and a stemmer for distinct terms."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from",
    "has", "have", "he", "i", "in", "is", "it", "its", "me", "my",
    "of", "on", "or", "she", "that", "the", "they", "this", "to",
    "us", "was", "we", "what", "which", "who", "will", "with", "you",
    "do", "does", "did", "find", "how", "can", "use",
]


#: Small Latin letters with marks, and the plain letter that each is decomposed to.
FOLDED = {chr(i): d[0] for i in [*range(0xE0, 0x250), *range(0x1E00, 0x1F00)] if (d := unicodedata.normalize("NFD", chr(i))) != chr(i) and "a" <= d[0] <= "z"}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fold(c: Column | str) -> Column:
    """Lower case without the accents of Latin letters; one character for one, so places are kept."""
    return F.translate(F.lower(col(c)), "".join(FOLDED), "".join(FOLDED.values()))


def tokens(c: Column | str, folded: bool = False) -> Column:
    """Runs of letters and digits, in lower case, in order. A null text has none."""
    text = fold(c) if folded else F.lower(col(c))
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}]+"), 0)


def spaced(c: Column | str, folded: bool = False) -> Column:
    """tokens() as one string, with a space after each: cheaper to hand on than an array."""
    text = fold(c) if folded else F.lower(col(c))
    return F.ltrim(F.regexp_replace(F.concat(F.coalesce(text, F.lit("")), F.lit(" ")), r"[^\p{L}\p{N}]+", " "))


def query_terms(c: Column | str, ascii_terms: bool = True, folded: bool = False) -> Column:
    """Terms of a query: its words less the stop words, or all of them where fewer than two of several would stay."""
    words = F.regexp_extract_all(fold(c) if folded else F.lower(col(c)), F.lit("[a-z0-9]+" if ascii_terms else r"[\p{L}\p{N}]+"), 0)
    terms = F.filter(words, lambda w: ~w.isin(STOP_WORDS))
    return F.when((F.size(terms) < 2) & (F.size(words) >= 2), words).otherwise(terms)


def clean_snippet(c: Column | str, most: int = 240) -> Column:
    """White space collapsed, cut to `most` characters with three dots; null where nothing is left."""
    text = F.trim(F.regexp_replace(col(c), r"\s+", " "))
    cut = F.concat(F.rtrim(F.substring(text, 1, most - 3)), F.lit("..."))
    return F.nullif(F.when(F.length(text) > most, cut).otherwise(text), F.lit(""))


def preview(c: Column | str, most: int) -> Column:
    """The first `most` characters, with three dots only where more was there."""
    return F.when(F.length(col(c)) > most, F.concat(F.substring(col(c), 1, most), F.lit("..."))).otherwise(col(c))


def folded_case(c: Column | str) -> Column:
    """Lower case in which both small sigmas are one."""
    return F.translate(F.lower(col(c)), "ς", "σ")


def occurrences(text: Column | str, needle: Column | str) -> Column:
    """Places (from 0) of the needle, overlapping ones too, without regard to case. An empty or null needle has none.

    A look-ahead cuts the text before each match, so the text is read once however many matches there are.
    """
    hay, pin = folded_case(text), folded_case(needle)
    quoted = F.concat(F.lit("(?="), F.regexp_replace(pin, r"([^\p{L}\p{N}])", r"\\$1"), F.lit(")"))
    pieces = F.split(F.concat(F.lit("\u0001"), hay), quoted)  # a piece in front, so a match at the start cuts as well
    sizes = F.transform(pieces, lambda p: F.length(p))
    ends = F.aggregate(F.slice(sizes, 1, F.size(sizes) - 1), F.array().cast("array<int>"), lambda acc, n: F.array_append(acc, F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(-1)) + n))
    return F.when((F.length(pin) > 0) & hay.isNotNull(), ends).otherwise(F.array().cast("array<int>"))


def line_col(text: Column | str, offset: Column | str) -> Column:
    """Line and column (from 0) of a place."""
    before = F.substr(col(text), F.lit(1), col(offset))
    return F.struct((F.length(before) - F.length(F.replace(before, F.lit("\n")))).alias("line"), F.length(F.substring_index(before, "\n", -1)).alias("column"))


def estimate_tokens(c: Column | str) -> Column:
    """A quarter of the characters, rounded down."""
    return F.floor(F.length(col(c)) / 4).cast("int")


VOWELS = "aeiou"


def _consonant(w: str, i: int) -> bool:
    return w[i] not in VOWELS and not (w[i] == "y" and i and _consonant(w, i - 1))


def _measure(w: str) -> int:
    """How often a vowel is followed by a consonant."""
    kinds = [_consonant(w, i) for i in range(len(w))]
    return sum(b and not a for a, b in zip(kinds, kinds[1:]))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1)


def _cvc(w: str) -> bool:
    n = len(w)
    return n > 2 and _consonant(w, n - 3) and not _consonant(w, n - 2) and _consonant(w, n - 1) and w[-1] not in "wxy"


def _has_vowel(w: str) -> bool:
    return any(not _consonant(w, i) for i in range(len(w)))


# Suffixes of steps 2 to 4 of Porter (1980).
STEP_2 = dict(p.split(":") for p in "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble".split())
STEP_3 = dict(p.split(":") for p in "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:".split())
STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def porter(w: str) -> str:
    """The stem of a lower-case word; words of other than a-z, and short ones, stay as they are."""
    if len(w) <= 2 or not (w.isascii() and w.isalpha()):
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and _has_vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif _double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (STEP_2, STEP_3):
        end = max((e for e in table if w.endswith(e)), key=len, default="")
        if end and _measure(w[: -len(end)]):
            w = w[: -len(end)] + table[end]
    end = max((e for e in STEP_4 if w.endswith(e)), key=len, default="")
    if end and _measure(w[: -len(end)]) > 1 and (end != "ion" or w[: -len(end)].endswith(("s", "t"))):
        w = w[: -len(end)]
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not _cvc(w[:-1]):
            w = w[:-1]
    if _measure(w) > 1 and _double(w) and w.endswith("l"):
        w = w[:-1]
    return w


def stemmed(c: Column | str) -> Column:
    """The stem of each word: each distinct word of a batch is stemmed once, and a worker remembers some of them."""

    @F.pandas_udf("string")
    def stem(words: pd.Series) -> pd.Series:
        codes, distinct = pd.factorize(words)
        return pd.Series(np.array([*map(remembered, distinct), None], object)[codes])

    return stem(col(c))


@lru_cache(200_000)
def remembered(w: str) -> str:
    return porter(w)


def stems(terms: DataFrame, term: str = "term") -> DataFrame:
    """term, stem for each distinct term."""
    return terms.select(term).distinct().withColumn("stem", stemmed(term))
