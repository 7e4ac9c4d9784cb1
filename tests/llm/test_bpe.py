"""Encoding and decoding against the tokenizers library."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer, pre_tokenizers

from tidewell.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def coder():
    return bpe.BPE(PATH, kept=3000)


@pytest.fixture(scope="module")
def theirs():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def texts():
    pick = random.Random(11)
    bits = ["a", "A", "the", "tion", "é", "ü", "漢字", "😀", "1", "42", "²", "'s", "'ll", "'", "!!", " ", "  ", "\n", "\t", " \n", "\x1c", "\x85", "　", "​", "<|endoftext|>", "<|", "-", "_", "ſ", "́", "aaaa", "\x00"]
    out = ["".join(pick.choices(bits, k=pick.randrange(40))) for _ in range(3000)]
    return [*out, "", None, " ", "a" * 5000, "ab " * 5000, "\n" * 700, "x" + " " * 999 + "y"]


def test_same_ids_and_text_as_the_library(coder, theirs, texts):
    for _ in range(2):
        for a, b, ids, at in coder.encode(pa.array(texts)):
            back = coder.decode(ids, at)
            for i in range(b - a):
                expected = theirs.encode(texts[a + i] or "", add_special_tokens=False).ids
                assert ids[at[i] : at[i + 1]].tolist() == expected, repr(texts[a + i])
                assert bpe.as_text(back[i]) == theirs.decode(expected, skip_special_tokens=False)


def test_any_ids_decode_as_in_the_library(coder, theirs):
    rng = np.random.default_rng(2)
    for _ in range(300):
        ids = rng.integers(0, coder.size, rng.integers(0, 30))
        assert bpe.as_text(coder.decode(ids, np.array([0, len(ids)]))[0]) == theirs.decode(ids.tolist(), skip_special_tokens=False)


def test_random_bytes_of_letters(coder):
    pick = random.Random(4)
    words = ["".join(pick.choices("abehinorst", k=pick.randrange(1, 25))).encode() for _ in range(20000)]
    assert coder.encode_words(words) == [coder.merged(w) for w in words]
    assert coder.ordered and 0 < coder.failed < coder.asked


def test_pre_tokens_of_all_characters():
    theirs, wrong = pre_tokenizers.ByteLevel(add_prefix_space=False), []
    for first in range(0, 0x20000, 16):
        text = "".join(f"a{chr(c)}1{chr(c)}." for c in range(first, first + 16) if not 0xD800 <= c < 0xE000)
        if [text[x:y] for _, (x, y) in theirs.pre_tokenize_str(text)] != bpe.pre_tokens(text):
            wrong.append(first)
    assert not wrong, wrong


def test_query_columns(spark, texts):
    rows = [(t, i, "x", 1) for i, t in enumerate(texts[-60:])] + [("again", None, None, None)]
    docs = spark.createDataFrame(rows, "text string, doc_id long, ids string, n_tokens int")
    full = {r.doc_id: r for r in bpe.encode_decode(docs, PATH).collect()}
    assert len(full) == len(rows) and full[0].decoded == (rows[0][0] or "")
    assert bpe.encode_decode(docs, PATH, digests=True).count() == len(rows)
    assert bpe.encode_decode(docs.limit(0), PATH, digests=True).count() == 0
