"""Whole-text encoding with a byte-level BPE vocabulary, one look-up per distinct segment."""

from __future__ import annotations

import base64
import os
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc

from sessionlake.llm.common import held

BYTE_BPE, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
#: A text with one of these isn't cut by the two plain rules: white space of another kind, two characters of it in a row, or the mark of cuts.
ODD = "[\\t\\x0b\\x0c\\r\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x00]|[ \\n]{2}"
#: A space that begins a pre-token whatever is around it.
CUT = re.compile(r"(?<=\S) (?=\S)")
SPECIAL = "<|"
LONG = 4096


class ByteEncoder:
    """Ids of whole texts, as the tokenizers library gives them without settings but add_special_tokens=False.

    A pre-token never goes on from other characters into white space, and a single space begins the pre-token of the word behind it. So a text
    is cut before single spaces and around single line ends, and each distinct segment is encoded once while it is kept; `keep` bounds
    how many are. New segments are encoded together by the tiktoken library, with the same vocabulary as ranks, and told apart
    by the places of their bytes. Segments with other white space are encoded alone; long ones, and those that may hold the string of
    a special token, by the tokenizers library.
    """

    def __init__(self, path: str = BYTE_BPE, ranks: str = RANKS, keep: int = 1_000_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        with open(ranks, "rb") as f:
            found = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}
        self.plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=found, special_tokens={})
        self.size = np.zeros(max(found.values()) + 1, np.int64)
        self.size[list(found.values())] = [len(b) for b in found]
        self.keep, (self.line,) = keep, self.plain.encode_ordinary("\n")
        self.forget()

    def forget(self) -> None:
        """Starts with no known segments: their strings, the ids of all of them, and how many are whose."""
        self.segments, self.pool, self.sizes = pa.array([], pa.string()), np.zeros(0, "<u4"), np.zeros(0, np.int64)

    def together(self, segments: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of segments and how many each has; none has white space but one space as its first character. A line end goes before those without."""
        spaced = pc.if_else(pc.starts_with(segments, " "), segments, pc.binary_join_element_wise("\n", segments, ""))
        ends = np.frombuffer(spaced.buffers()[1], np.int32)[spaced.offset : spaced.offset + len(spaced) + 1].astype(np.int64)
        data = spaced.buffers()[2][int(ends[0]) : int(ends[-1])].to_pybytes().decode()
        ids = self.plain.encode_to_numpy(data, disallowed_special=()).astype(np.int64)
        places = np.cumsum(self.size[ids]) - self.size[ids]
        own = ids != self.line
        many = np.bincount(np.searchsorted(ends[1:] - ends[0], places[own], side="right"), minlength=len(segments))
        return ids[own].astype("<u4"), many

    def alone(self, segment: str) -> np.ndarray:
        """Ids of any text."""
        plain = len(segment) < LONG and SPECIAL not in segment
        return np.array(self.plain.encode_ordinary(segment) if plain else self.full.encode(segment, add_special_tokens=False).ids, "<u4")

    def learn(self, new: pa.Array) -> np.ndarray:
        """Encodes segments not met before, and gives their numbers."""
        simple = pc.and_not(pc.match_substring_regex(new, "^ ?[^ \\n]+$"), pc.or_(pc.match_substring_regex(new, ODD), pc.or_(pc.match_substring(new, SPECIAL), pc.greater_equal(pc.binary_length(new), LONG))))
        many, rest = [self.sizes], new.filter(pc.invert(simple))
        ids, own = [self.pool], new.filter(simple)
        for i in range(0, len(own), 4096):
            found, sizes = self.together(own.slice(i, 4096))
            ids.append(found)
            many.append(sizes)
        for s in rest.to_pylist():
            ids.append(self.alone(s))
            many.append(np.array([len(ids[-1])]))
        numbers, first = np.zeros(len(new), np.int64), len(self.segments)
        which = simple.to_numpy(zero_copy_only=False)
        numbers[which], numbers[~which] = first + np.arange(len(own)), first + len(own) + np.arange(len(rest))
        self.segments, self.pool, self.sizes = pa.concat_arrays([self.segments, own, rest]), np.concatenate(ids), np.concatenate(many)
        return numbers

    def encode(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """Unsigned 32-bit ids of each UTF-8 text; a null text is empty."""
        if len(self.segments) > self.keep:
            self.forget()
        array = pa.array(texts, pa.binary()).fill_null(b"").cast(pa.string())
        odd = pc.match_substring_regex(array, ODD)
        cut = pc.split_pattern(pc.replace_substring(pc.replace_substring(pc.if_else(odd, "", array), " ", "\x00 "), "\n", "\x00\n\x00"), "\x00")
        coded = cut.values.dictionary_encode()
        places = pc.index_in(coded.dictionary, self.segments)
        new = places.is_null()
        numbers = places.fill_null(0).to_numpy().astype(np.int64)
        if places.null_count:
            numbers[new.to_numpy(zero_copy_only=False)] = self.learn(coded.dictionary.filter(new))
        at = numbers[coded.indices.to_numpy()]
        many = self.sizes[at]
        ends = np.concatenate([[0], np.cumsum(many)])
        ids = self.pool[np.repeat((np.cumsum(self.sizes) - self.sizes)[at] - ends[:-1], many) + np.arange(ends[-1])]
        cuts = ends[cut.offsets.to_numpy()].tolist()
        found = [ids[a:b] for a, b in zip(cuts, cuts[1:])]
        for i in pc.indices_nonzero(odd).to_pylist():
            found[i] = self.piecewise(array[i].as_py())
        return found

    def piecewise(self, text: str) -> np.ndarray:
        """Ids of a text with other white space, cut at single spaces only; each distinct segment once."""
        known: dict[str, np.ndarray] = {}
        segments = CUT.sub("\x00 ", text).split("\x00") if "\x00" not in text else [text]
        return np.concatenate([known[s] if s in known else known.setdefault(s, self.alone(s)) for s in segments])


def encoder(path: str = BYTE_BPE, ranks: str = RANKS) -> ByteEncoder:
    """This worker's encoder: Spark reuses the process, and with it the known segments."""
    return held(("byte_encoder", path, ranks), lambda: ByteEncoder(path, ranks))
