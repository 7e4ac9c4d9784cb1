"""Token ids of whole texts by the tokenizers library, with each distinct word looked up once per portion.

A text is cut only at spaces and newlines. That is exact for a vocabulary whose normaliser and
pre-tokeniser let no token touch white space (checked by `splits_at_space`): the ids of the whole
text are then those of its words, one after another. For a vocabulary that lower-cases and splits
marks from letters (`lowers_letters`) a word is its letters in lower case and the marks after them.

Cases: a null or empty text has no ids; repeated texts are encoded alike; no texts give no ranges; a
very long text is a range of its own. Nothing depends on what a worker has seen before.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from .common import SLAB_CHARS, bounds, portions, ragged

#: Words (or their letters) whose ids a worker keeps between portions; later ones are encoded again in each.
KEPT_WORDS = 400_000
#: Words encoded at once: the library's own results take some kB a word until their ids are out.
CODED_WORDS = 8_192

#: Precomposed Latin letters, then ASCII marks without an apostrophe: two pre-tokens of a lower-casing vocabulary.
LETTERS, MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-&(-/:-@\[-`{-~"


def splits_at_space(spec: dict) -> bool:
    """True if the vocabulary file drops white space between words, so that words can be encoded alone."""
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [spec.get("pre_tokenizer") or {}]
    split = next((s for s in steps if s.get("type") == "Split"), {})
    byte_level = all(not s.get("add_prefix_space") and not s.get("use_regex") for s in steps if s.get("type") == "ByteLevel")
    drops = split.get("behavior") == "Removed" and split.get("invert") and r"[^\s\p{L}\p{N}]+" in split.get("pattern", {}).get("Regex", "")
    plain = all(t["normalized"] is False and not t["lstrip"] and not t["rstrip"] and not t["single_word"] and not set(t["content"]) & set(" \n") for t in spec.get("added_tokens", []))
    return bool(drops and byte_level and plain and not spec.get("post_processor"))


def lowers_letters(spec: dict) -> bool:
    """True if a word's letters, in lower case, and the marks after them can be encoded apart."""
    steps = [s.get("type") for s in (spec.get("normalizer") or {}).get("normalizers", [])]
    split = next((s for s in (spec.get("pre_tokenizer") or {}).get("pretokenizers", []) if s.get("type") == "Split"), {})
    return splits_at_space(spec) and steps == ["NFC", "Replace", "Lowercase"] and r"|[\p{L}]+|" in split.get("pattern", {}).get("Regex", "")


class WordTable:
    """The ids of words, all one after another; `encode` gives them for words that are not kept yet."""

    def __init__(self, encode, kept: int = KEPT_WORDS):
        self.encode, self.kept = encode, kept
        self.words, self.ids, self.at = pa.array([], pa.string()), np.empty(0, np.uint32), np.zeros(1, np.int64)

    def numbers(self, words: pa.Array) -> np.ndarray:
        """A number for each of the distinct `words`, good until the next call; unknown ones are encoded together."""
        if len(self.words) > self.kept:  # the first seen stay, which are the frequent ones
            self.words, self.at = pa.concat_arrays([self.words[: self.kept]]), self.at[: self.kept + 1].copy()
            self.ids = self.ids[: self.at[-1]].copy()
        found = pc.index_in(words, value_set=self.words)
        fresh = words.filter(pc.is_null(found))
        if len(fresh):
            n, ids, lengths = len(self.words), [self.ids], []
            for a in range(0, len(fresh), CODED_WORDS):
                got = self.encode(fresh[a : a + CODED_WORDS].to_pylist())
                lengths.append(np.fromiter(map(len, got), np.int64, len(got)))
                ids.append(np.fromiter(chain.from_iterable(got), np.uint32, int(lengths[-1].sum())))
            self.words, self.ids = pa.concat_arrays([self.words, fresh]), np.concatenate(ids)
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(np.concatenate(lengths))])
            out = pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64)
            out[out < 0] = np.arange(n, n + len(fresh))
            return out
        return found.to_numpy(zero_copy_only=False).astype(np.int64)

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the numbered words in order, and how many each has."""
        starts = self.at[numbers]
        lengths = self.at[numbers + 1] - starts
        return self.ids[ragged(starts, lengths)], lengths


class TextEncoder:
    """Whole texts to ids. Null texts count as empty."""

    def __init__(self, path: str, kept: int = KEPT_WORDS):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_word, self.by_stem = splits_at_space(spec), lowers_letters(spec)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.words = WordTable(self.whole, kept)

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, boundaries) of distinct words."""
        if not self.by_stem:
            ids, lengths = self.words.gather(self.words.numbers(words))
            return ids, bounds(lengths)
        plain = pc.match_substring_regex(words, rf"^[{LETTERS}]+[{MARKS}]*\z")
        letters = pc.if_else(plain, pc.utf8_lower(pc.utf8_rtrim(words, "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")), words)
        marks = pc.if_else(plain, pc.replace_substring_regex(words, rf"^[{LETTERS}]+", ""), "")
        coded = pa.concat_arrays([letters, marks]).dictionary_encode()
        both = self.words.numbers(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]
        ids, lengths = self.words.gather(both.reshape(2, -1).T.ravel())  # letters, marks, letters, marks
        return ids, bounds(lengths)[::2]

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(a, b, ids of texts a to b, their boundaries), in order, for ranges of about `SLAB_CHARS`."""
        for first, own in portions(pc.fill_null(texts, "")):
            for a, b, ids, at in self._encode(own):
                yield first + a, first + b, ids, at

    def _encode(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        sizes = bounds(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        if self.by_word:
            parts = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
            coded = parts.flatten().dictionary_encode()
            own, ends = self._of_words(coded.dictionary)
            codes = coded.indices.to_numpy(zero_copy_only=False)
            at = bounds(pc.list_value_length(parts).to_numpy(zero_copy_only=False))
        a = 0
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(sizes, sizes[a] + SLAB_CHARS, "right")) - 1)
            if self.by_word:
                words = codes[at[a] : at[b]]
                lengths = ends[words + 1] - ends[words]
                yield a, b, own[ragged(ends[words], lengths)], bounds(lengths)[at[a : b + 1] - at[a]]
            else:
                got = self.whole(texts[a:b].to_pylist())
                ends = bounds([len(x) for x in got])
                yield a, b, np.fromiter(chain.from_iterable(got), np.uint32, int(ends[-1])), ends
            a = b


@lru_cache(maxsize=2)
def encoder(path: str) -> TextEncoder:
    """One encoder per worker process and vocabulary. A task has one core: the library's threads would only hold memory of their own."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return TextEncoder(path)
