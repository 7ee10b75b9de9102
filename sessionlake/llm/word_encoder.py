"""Whole-text encoding with the tokenizers library, one call per distinct word."""

from __future__ import annotations

import os

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc

from sessionlake.llm.common import held

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
#: Words that normalisation only lower-cases: printable ASCII, and composed Latin letters up to U+024F.
LATIN = "^[!-~\\x{a1}-\\x{24f}]*$"
#: Letters only: one pre-token as a rule, so an id that ends a word ends it. U+0130 becomes a letter and a mark, which are two.
LETTERS = "^[a-z\\x{df}-\\x{f6}\\x{f8}-\\x{12f}\\x{131}-\\x{24f}]+$"
#: Stands between other words that are encoded together; one id, and no part of any other.
MARK = "\x01"
#: Begins the strings of special tokens, which the library finds in a text as it is.
SPECIAL = "<|"


class WordEncoder:
    """Ids of whole texts for a vocabulary whose pre-tokenizer never joins characters across ASCII white space.

    Normalisation, splitting and merges then act on each white-space separated word alone, so the ids of a text
    are those of its words in order. The library encodes each distinct word once while it is kept; `keep` bounds
    the words kept, and a batch of texts is put together from them by position. Ids are the library's own without
    settings but add_special_tokens=False: the string of a special token in a text is that token.
    """

    def __init__(self, path: str = WORD_BPE, keep: int = 500_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers

        self.keep = keep
        self.full, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])  # for words that are lower-cased here
        (self.mark,) = self.full.encode(MARK, add_special_tokens=False).ids
        ends = {i for t, i in self.plain.get_vocab().items() if t.endswith("</w>")}
        self.last = np.array([i in ends for i in range(self.plain.get_vocab_size())])
        self.forget()

    def forget(self) -> None:
        """Starts with no known words: their strings, the ids of all of them, and how many are whose."""
        self.words, self.pool, self.sizes = pa.array([""], pa.string()), np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def learn(self, words: pa.Array) -> None:
        """Encodes words, many as one text with MARK between them."""
        marked, latin = pc.or_(pc.match_substring(words, MARK), pc.match_substring(words, SPECIAL)), pc.match_substring_regex(words, LATIN)
        letters = pc.and_(latin, pc.match_substring_regex(words, LETTERS))
        strings, ids, sizes = [self.words], [self.pool], [self.sizes]
        for tokenizer, chosen, between in ((self.plain, letters, " "), (self.plain, pc.and_not(latin, pc.or_(letters, marked)), f" {MARK} "), (self.full, pc.invert(pc.or_(latin, marked)), f" {MARK} ")):
            own = words.filter(chosen)
            for i in range(0, len(own), 4096):
                some = own.slice(i, 4096).to_pylist()
                text = between.join(some)
                found = np.array(tokenizer.encode_batch_fast([text.lower() if tokenizer is self.plain else text], add_special_tokens=False)[0].ids, "<u4")
                if between == " ":
                    many = np.diff(np.flatnonzero(np.concatenate([[True], self.last[found]])))
                else:
                    cut = found == self.mark
                    many, found = np.diff(np.flatnonzero(np.concatenate([[True], cut, [True]]))) - 1, found[~cut]
                if len(many) != len(some) or many.sum() != len(found):  # a word of another form than its class: each by itself
                    each = [self.full.encode(w, add_special_tokens=False).ids for w in some]
                    many, found = np.array([len(x) for x in each]), np.array([x for w in each for x in w], "<u4")
                sizes.append(many)
                ids.append(found)
            strings.append(own)
        strings.append(words.filter(marked))
        for w in strings[-1].to_pylist():
            ids.append(np.array(self.full.encode(w, add_special_tokens=False).ids, "<u4"))
            sizes.append(np.array([len(ids[-1])]))
        self.words, self.pool, self.sizes = pa.concat_arrays(strings), np.concatenate(ids), np.concatenate(sizes)

    def encode(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """Unsigned 32-bit ids of each text; a null text is empty."""
        if len(self.words) > self.keep:
            self.forget()
        # A combining mark may compose with a capital only or a small letter only, and strings of special tokens have a case, so texts with one keep their capitals here.
        marked = [t is not None and (b"\xcc" in t or b"\xcd" in t or b"<|" in t) for t in texts]
        array = pa.array(texts, pa.binary()).fill_null(b"").cast(pa.string())
        lower = pc.ascii_lower(array)
        words = pc.ascii_split_whitespace(pc.if_else(pa.array(marked), array, lower) if any(marked) else lower)
        coded = words.values.dictionary_encode()
        places = pc.index_in(coded.dictionary, self.words)
        if places.null_count:
            self.learn(coded.dictionary.filter(places.is_null()))
            places = pc.index_in(coded.dictionary, self.words)
        known = places.to_numpy()[coded.indices.to_numpy()]
        many = self.sizes[known]
        ends = np.concatenate([[0], np.cumsum(many)])
        ids = self.pool[np.repeat((np.cumsum(self.sizes) - self.sizes)[known] - ends[:-1], many) + np.arange(ends[-1])]
        cuts = ends[words.offsets.to_numpy()].tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]


def encoder(path: str = WORD_BPE) -> WordEncoder:
    """This worker's encoder: Spark reuses the process, and with it the known words."""
    return held(("word_encoder", path), lambda: WordEncoder(path))
