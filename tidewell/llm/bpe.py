"""Byte-level BPE encoding and decoding by speculation.

For each distinct pre-token, greedy longest-match proposes tokens. The proposal is the BPE result if every
token is the BPE result of its own bytes and every adjacent pair is compatible: going back in time from the
two finished tokens, no pair of neighbours at their boundary may merge before either takes its place. That
check runs on arrays over all proposals at once; only words that fail it are merged exactly.

A worker keeps the ids of words it has seen (bounded); texts are cut at single spaces between words, where
no pre-token can begin or end elsewhere, and texts with other white space around spaces go whole through
the pre-tokeniser. No shuffle; memory is one Arrow batch and the tables.

Cases: a null or empty text has no ids and decodes to the empty text; special tokens in a text are their
ids, as in the tokenizers library; ids decode to bytes and those to text with U+FFFD for what is not UTF-8;
repeated rows, null keys and extra columns do not matter; an empty table gives no rows; a very long text or
word is encoded whole (exact merging takes n log n steps).
"""

from __future__ import annotations

import hashlib
import heapq
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import pre_tokenizers

from .common import SLAB_CHARS, bounds, portions, ragged, trimmed

#: The pre-tokeniser of byte-level vocabularies with use_regex: fixed values.
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Below this character the pattern's classes are the same in every Unicode version; with others the library's own pre-tokeniser is asked.
SETTLED = "\u0370"
LIBRARY = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
NEVER = np.int64(1) << 40


def pre_tokens(text: str) -> list[str]:
    if not text or max(text) < SETTLED:
        return PRE_TOKEN.findall(text)
    return [text[a:b] for _, (a, b) in LIBRARY.pre_tokenize_str(text)]


def byte_chars() -> dict[str, int]:
    """Character -> byte in vocabulary files: printable bytes stand for themselves, the others for 256, 257, ..."""
    kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(other)}


#: Words and pre-tokens that a worker keeps between batches; later ones are encoded again in each batch.
KEPT_WORDS, KEPT_STEMS = 200_000, 300_000


def packed(ids: list[list[int]]) -> list[bytes]:
    return [array("I", x).tobytes() for x in ids]


class WordTable:
    """word -> its ids, all ids one after another in one array that grows in place. `encode`: words to ids as bytes."""

    def __init__(self, encode, kept: int = KEPT_WORDS):
        self.encode, self.kept, self.index = encode, kept, {}
        self.ids, self.at = np.empty(1 << 16, np.uint32), np.zeros(1 << 14, np.int64)

    def numbers(self, words: list[str]) -> np.ndarray:
        """A number for each of the distinct `words`; unknown ones are encoded together first."""
        self.forget()
        fresh = [w for w in words if w not in self.index]
        if fresh:
            got, n = self.encode(fresh), len(self.index)
            lengths = np.fromiter(map(len, got), np.int64, len(got)) // 4
            first = int(self.at[n])
            need = first + int(lengths.sum())
            if need > len(self.ids):
                self.ids = np.concatenate([self.ids[:first], np.empty(need + need // 2 - first, np.uint32)])
            if n + len(got) + 1 > len(self.at):
                self.at = np.concatenate([self.at[: n + 1], np.zeros((n + len(got)) // 2 + len(got) + 1, np.int64)])
            self.ids[first:need] = np.frombuffer(b"".join(got), np.uint32)
            self.at[n + 1 : n + len(got) + 1] = first + np.cumsum(lengths)
            self.index.update(zip(fresh, range(n, n + len(got)), strict=True))
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the numbered words in order, and how many each has."""
        starts = self.at[numbers]
        lengths = self.at[numbers + 1] - starts
        return self.ids[ragged(starts, lengths)], lengths

    def forget(self) -> None:
        """Drop the words beyond the kept ones; the first seen stay, which are the frequent ones."""
        while len(self.index) > self.kept:
            self.index.popitem()


class BPE:
    def __init__(self, path: str, kept: int = KEPT_WORDS):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = byte_chars()
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        size = max([*vocab.values(), *self.special.values()]) + 1
        raw = [b""] * size
        for token, i in vocab.items():
            raw[i] = bytes(to_byte[c] for c in token)
        for token, i in self.special.items():
            raw[i] = token.encode()
        self.raw, self.size = raw, size
        self.raw_at = bounds([len(x) for x in raw])
        self.raw_bytes = np.frombuffer(b"".join(raw), np.uint8)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left, right = (np.array([vocab[m[j]] for m in merges], np.int64) for j in (0, 1))
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        #: When a token is made (-1: a byte), and its parts.
        self.made_at, self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self.made_at[made[::-1]], self.left[made[::-1]], self.right[made[::-1]] = np.arange(len(merges))[::-1], left[::-1], right[::-1]
        keys = left * size + right
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_ranks = keys[order], order
        self.rules = {(a, b): (r, m) for r, (a, b, m) in reversed(list(enumerate(zip(left.tolist(), right.tolist(), made.tolist(), strict=True))))}
        self.of_byte = [vocab.get(c, -1) for c, _ in sorted(to_byte.items(), key=lambda x: x[1])]
        #: True if merges come after those that make their parts, which the check by pairs needs.
        self.ordered = bool((self.made_at[left] < np.arange(len(merges))).all() and (self.made_at[right] < np.arange(len(merges))).all() and len(set(made.tolist())) == len(merges))
        whole = self.whole_tokens(made, left, right)
        self.greedy = {raw[i]: i for i in [x for x in self.of_byte if x >= 0] + whole}
        self.longest = max(map(len, self.greedy))
        self.words, self.pre_tokens = WordTable(self._encode_chunks, kept), {}
        self.asked = self.failed = 0

    def whole_tokens(self, made: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[int]:
        """Tokens that are the BPE result of their own bytes."""
        good = np.zeros(self.size, bool)
        good[[x for x in self.of_byte if x >= 0]] = True
        fits = self.compatible(left, right, apart=False)
        for t, a, b, ok in zip(made.tolist(), left.tolist(), right.tolist(), fits.tolist(), strict=True):
            good[t] = ok and good[a] and good[b]
        return np.flatnonzero(good & (self.made_at >= 0)).tolist()

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NEVER)

    def compatible(self, x: np.ndarray, y: np.ndarray, apart: bool = True) -> np.ndarray:
        """For each pair: no merge crosses its boundary. `apart`: the two finished tokens must not merge either."""
        fits, live = np.ones(len(x), bool), np.arange(len(x))
        x_end, y_end = np.full(len(x), NEVER), np.full(len(x), NEVER)  # when x and y become part of a larger token
        first = not apart
        while len(live):
            if not first:
                rank = self.ranks(x, y)
                # At equal ranks the leftmost merge is first: the one within the left token, then the crossing one.
                crossed = (rank < NEVER) & (rank < x_end) & (rank <= y_end)
                fits[live[crossed]] = False
            else:
                crossed = np.zeros(len(x), bool)
            first = False
            x_at, y_at = self.made_at[x], self.made_at[y]
            go = ~crossed & ((x_at >= 0) | (y_at >= 0))
            live, x, y, x_end, y_end, x_at, y_at = (v[go] for v in (live, x, y, x_end, y_end, x_at, y_at))
            back_x = x_at > y_at  # of equal ones the right token is the later one
            x_end, y_end = np.where(back_x, x_at, x_end), np.where(back_x, y_end, y_at)
            x, y = np.where(back_x, self.right[x], x), np.where(back_x, y, self.left[y])
        return fits

    def longest_match(self, word: bytes) -> list[int]:
        out, at, n, greedy, longest = [], 0, len(word), self.greedy, self.longest
        while at < n:
            end = min(n, at + longest)
            while word[at:end] not in greedy:
                end -= 1
            out.append(greedy[word[at:end]])
            at = end
        return out

    def merged(self, word: bytes) -> list[int]:
        """Exact merging: the lowest rank first, the leftmost of equal ones."""
        ids = [self.of_byte[b] for b in word]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.rules.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = self.rules[a, b][1], -1, after[j]
            if after[j] < n:
                before[after[j]] = i
                if r := self.rules.get((ids[i], ids[after[i]])):
                    heapq.heappush(heap, (r[0], i, ids[i], ids[after[i]]))
            if before[i] >= 0 and (r := self.rules.get((ids[before[i]], ids[i]))):
                heapq.heappush(heap, (r[0], before[i], ids[before[i]], ids[i]))
        return [t for t in ids if t >= 0]

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Speculates on all words, checks all pairs at once, merges exactly the words that fail."""
        if not self.ordered:
            return [self.merged(w) for w in words]
        proposed = [self.longest_match(w) for w in words]
        at = bounds([len(p) for p in proposed])
        flat = np.fromiter((t for p in proposed for t in p), np.int64, int(at[-1]))
        owner = np.repeat(np.arange(len(words)), np.diff(at))
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, back = np.unique(flat[inner] * self.size + flat[inner + 1], return_inverse=True)
        fits = self.compatible(pairs // self.size, pairs % self.size)[back]
        wrong = np.unique(owner[inner[~fits]]).tolist()
        self.asked, self.failed = self.asked + len(words), self.failed + len(wrong)
        for i in wrong:
            proposed[i] = self.merged(words[i])
        return proposed

    def _pieces(self, chunk: str) -> list:
        """Pre-tokens (str) and special ids (int) of a chunk."""
        if not self.special or not self.split_special.search(chunk):
            return pre_tokens(chunk)
        out, at = [], 0
        for m in self.split_special.finditer(chunk):
            out += [*pre_tokens(chunk[at : m.start()]), self.special[m[0]]]
            at = m.end()
        return out + pre_tokens(chunk[at:])

    def _encode_chunks(self, chunks: list[str]) -> list[bytes]:
        if len(self.pre_tokens) > KEPT_STEMS:
            self.pre_tokens.clear()
        known = self.pre_tokens
        pieces = [self._pieces(c) for c in chunks]
        fresh = list({x for own in pieces for x in own if x.__class__ is str and x not in known})
        known.update(zip(fresh, packed(self.encode_words([w.encode() for w in fresh])), strict=True))
        return [b"".join(known[x] if x.__class__ is str else packed([[x]])[0] for x in own) for own in pieces]

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(a, b, ids of texts a to b, their boundaries), in order, for ranges of about `SLAB_CHARS`."""
        for first, own in portions(pc.fill_null(texts, "")):
            for a, b, ids, at in self._encode(own):
                yield first + a, first + b, ids, at

    def _encode(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        sizes = bounds(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        parts = pc.split_pattern(texts, " ")
        at = bounds(pc.list_value_length(parts).to_numpy(zero_copy_only=False))
        coded = parts.flatten().dictionary_encode()
        codes, names = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
        unsafe = np.fromiter((not w or w[0].isspace() or w[-1].isspace() for w in names), bool, len(names))
        whole = np.logical_or.reduceat(unsafe[codes], at[:-1]) if len(texts) else np.zeros(0, bool)
        firsts = at[:-1]
        heads = [names[c] for c in codes[firsts].tolist()]
        self.words.numbers(list(dict.fromkeys([" " + w for w in names] + heads)))
        mid = np.fromiter((self.words.index[" " + w] for w in names), np.int64, len(names))
        head = np.fromiter((self.words.index[w] for w in heads), np.int64, len(heads))
        a = 0
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(sizes, sizes[a] + SLAB_CHARS, "right")) - 1)
            numbers = mid[codes[at[a] : at[b]]]
            numbers[firsts[a:b] - at[a]] = head[a:b]
            ids, lengths = self.words.gather(numbers)
            edges = bounds(lengths)[at[a : b + 1] - at[a]]
            if whole[a:b].any():
                odd = np.flatnonzero(whole[a:b])
                own = dict(zip(odd.tolist(), self._encode_chunks([texts[a + int(i)].as_py() for i in odd]), strict=True))
                rows = [np.frombuffer(own[i], np.uint32) if i in own else ids[edges[i] : edges[i + 1]] for i in range(b - a)]
                ids, edges = np.concatenate(rows), bounds([len(r) for r in rows])
            yield a, b, ids, edges
            a = b

    def decode(self, ids: np.ndarray, edges: np.ndarray) -> list[bytes]:
        """The bytes of each text's ids."""
        ids = ids.astype(np.int64, copy=False)
        starts = self.raw_at[ids]
        lengths = self.raw_at[ids + 1] - starts
        data, at = self.raw_bytes[ragged(starts, lengths)].tobytes(), bounds(lengths)[edges].tolist()
        return [data[x:y] for x, y in zip(at, at[1:], strict=False)]


@lru_cache(maxsize=2)
def bpe(path: str) -> BPE:
    """One per worker process and vocabulary."""
    return BPE(path)


def as_text(data: bytes) -> str:
    return data.decode("utf-8", "replace")


def encode_decode(docs: DataFrame, vocabulary: str, digests: bool = False, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: its ids and the text they decode to, or (`digests`) the SHA-256 of either."""
    schema = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<long>, decoded string")

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(vocabulary)
        for rb in batches:
            for a, b, ids, edges in coder.encode(rb.column(1)):
                plain, at = ids.astype("<u4").tobytes(), edges.tolist()
                texts = [as_text(x) for x in coder.decode(ids, edges)]
                if digests:
                    one = [hashlib.sha256(plain[4 * x : 4 * y]).hexdigest() for x, y in zip(at, at[1:], strict=False)]
                    two = [hashlib.sha256(t.encode()).hexdigest() for t in texts]
                else:
                    one, two = pa.LargeListArray.from_arrays(pa.array(edges), pa.array(ids.astype(np.int64))).cast(pa.list_(pa.int64())), texts
                yield pa.RecordBatch.from_arrays([rb.column(0)[a:b], pa.array(np.diff(edges)), pa.array(one), pa.array(two, pa.string())], ["doc_id", "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)
