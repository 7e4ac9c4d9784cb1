"""Packing and binary records against the tokenizers library on small, awkward documents."""

import random
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidewell.llm import packing, records
from tidewell.llm.wordcache import TextEncoder, WordTable

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "text string, doc_id long, ids string, sequence_id int"


@pytest.fixture(scope="module")
def rows():
    pick = random.Random(5)
    words = ["The", "ouéa", "tion,", "ÜBER", "x²", "漢字", "<|endoftext|>", "it's", "é", "\tab", " ", "İΣ", ""]
    texts = [" ".join(pick.choices(words, k=pick.randrange(60))) for _ in range(60)]
    texts += [None, "", " ", "\n\n", "abc " * 9000, texts[0], texts[0]]
    return [(t, i, "clash", i) for i, t in enumerate(texts)] + [("no key", None, "", 0), ("again", 3, "", 0)]


@lru_cache
def tokenizer():
    return Tokenizer.from_file(VOCABULARY)


def whole(text):
    return tokenizer().encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_words_encode_as_whole_texts(rows):
    import pyarrow as pa

    enc = TextEncoder(VOCABULARY, kept=50)
    for _ in range(2):
        got = [ids[at[i] : at[i + 1]].tolist() for a, b, ids, at in enc.encode(pa.array([r[0] for r in rows])) for i in range(b - a)]
        assert got == [whole(r[0]) for r in rows]


def test_new_words_are_encoded_in_slices():
    import pyarrow as pa

    calls = []
    table = WordTable(lambda words: calls.append(len(words)) or [[len(w)] * (int(w) % 3) for w in words], kept=30_000)
    for first in (0, 15_000):
        words = pa.array([str(i) for i in range(first, first + 20_000)])
        ids, lengths = table.gather(table.numbers(words))
        assert lengths.tolist() == [i % 3 for i in range(first, first + 20_000)]
        assert ids.tolist() == [len(str(i)) for i in range(first, first + 20_000) for _ in range(i % 3)]
    assert sum(calls) == 35_000 and max(calls) <= 8_192  # one call had all new words of a portion before


def test_packing_covers_every_id_once(spark, rows):
    got = packing.pack(spark.createDataFrame(rows, SCHEMA), VOCABULARY, 2048, 1, with_ids=True).collect()
    expected = sorted((repr(r[1]), tuple([*whole(r[0]), 1])) for r in rows)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        assert r.ids_crc32 == crc(r.ids) and len(r.ids) == r.length
        pieces[repr(r.doc_id), r.doc_tokens].append(r)
        sequences[r.sequence_id].append((r.offset, r.length, r.sequence_length))
    for s in sequences.values():
        at = 0
        for offset, length, total in sorted(s):
            assert offset == at
            at += length
        assert at == total <= 2048
    documents = []
    for (key, _), own in pieces.items():  # no two documents have the same key and number of ids
        assert len({r.start for r in own}) == len(own)
        documents.append((key, tuple(i for r in sorted(own, key=lambda r: r.start) for i in r.ids)))
    assert sorted(documents) == expected


def test_differencing_is_near_equal():
    sizes = np.random.default_rng(3).integers(1, 513, 700)
    window, loads = packing.differencing(sizes, 90)
    assert (np.bincount(window, sizes, 90).astype(int) == loads).all() and loads.max() - loads.min() <= 12
    assert np.bincount(packing.balanced(sizes, 2048), sizes).max() <= 2048
    assert packing.balanced(np.array([2000, 2000, 90]), 2048).max() == 2


def test_records_round_trip(spark, rows):
    got = records.write_and_read(spark.createDataFrame(rows, SCHEMA), VOCABULARY, 2, with_ids=True).orderBy("start").collect()
    order = lambda x: (x[0] is not None, x[0] or 0, x[1])
    assert [r.doc_id for r in got] == sorted((r[1] for r in rows), key=lambda k: (k is not None, k or 0))
    assert sorted(((r.doc_id, r.ids) for r in got), key=order) == sorted(((r[1], [*whole(r[0]), 2]) for r in rows), key=order)
    at = 0
    for r in got:
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(r.ids), crc(r.ids))
        at += r.n_tokens


def test_damage_is_seen():
    data = bytearray(records.frame(records.record(7, np.array([1, 2, 3], "<u2"))))
    assert records.unrecord(records.unframe(bytes(data))[0], 2)[1].tolist() == [1, 2, 3]
    for i in range(len(data)):
        bad = data.copy()
        bad[i] ^= 1
        with pytest.raises(ValueError):
            records.unframe(bytes(bad))


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert packing.pack(empty, VOCABULARY).count() == 0
    assert records.write_and_read(empty, VOCABULARY).count() == 0
