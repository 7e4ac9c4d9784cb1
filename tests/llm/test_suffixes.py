"""Suffix dedup against a table of all 200-byte strings."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tidewell.llm import queries, suffixes

SF = "/root/testdata/sf0.001"


def brute(rows, length):
    data = [(k, (t or "").encode()) for k, t in rows]
    times = Counter(d[i : i + length] for _, d in data for i in range(len(d) - length + 1))
    out = []
    for k, d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if times[d[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((k, len(d), int(gone.sum()), edges, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=repr)


def test_whole_table_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert got(queries.op2_suffix_dedup(spark, SF)) == brute(rows, 200)


@pytest.fixture(scope="module")
def awkward():
    pick = random.Random(6)
    word = lambda n: "".join(pick.choices("abc é漢\n", k=n))
    passage, tail = word(90), word(70)
    texts = [None, "", "a", "x" * 300, "x" * 60, "ab" * 100, word(40)]
    texts += [word(pick.randrange(60)) + passage + word(pick.randrange(60)) for _ in range(40)]
    texts += [word(pick.randrange(30)) + passage[:45] + tail for _ in range(20)] + [tail + tail, passage * 3]
    return [(i, t) for i, t in enumerate(texts)] + [(None, "y" * 50), (None, passage), (3, "x" * 300), (7, "again " + passage)]


@pytest.mark.parametrize("hot", [600_000, 400])
def test_awkward_rows(spark, awkward, hot):
    docs = spark.createDataFrame([(t, i, 1, "c") for i, t in awkward], "text string, doc_id long, h int, spans string")
    df = suffixes.dedup(docs, length=40, gram=12, digests=True, hot=hot)
    assert got(df) == brute(awkward, 40)
    plain = {(r.doc_id, r.n_removed): r for r in suffixes.dedup(docs, length=40, gram=12, hot=hot).collect()}
    for i, t in awkward[:20]:
        r = next(v for k, v in plain.items() if k[0] == i)
        data = (t or "").encode()
        cut = {x for s in r.spans for x in range(s.start, s.end)}
        assert len(cut) == r.n_removed and bytes(b for x, b in enumerate(data) if x not in cut) == bytes(r.kept) or i == 3


def test_repeated_rows_are_cut_once(spark):
    """Many rows with one key and text are one text to search, and all of them lose what repeats."""
    pick = random.Random(8)
    passage = "".join(pick.choices("abcdefgh", k=120))
    rows = [(None, passage)] * 30 + [(5, passage)] * 30 + [(1, "own " + passage[:80]), (2, "x" + passage[40:])]
    docs = spark.createDataFrame([(t, i) for i, t in rows], "text string, doc_id long").repartition(7)
    assert got(suffixes.dedup(docs, length=40, gram=12, digests=True)) == brute(rows, 40)


def test_empty_table(spark):
    assert suffixes.dedup(spark.createDataFrame([], "text string, doc_id long")).count() == 0


def test_interval_expansion_alone():
    pick = random.Random(2)
    for length in (2, 5, 9):
        for _ in range(60):
            strings = ["".join(pick.choices("ab", k=pick.randrange(25))).encode() for _ in range(pick.randrange(1, 9))]
            weights = np.array([pick.choice([1, 1, 2]) for _ in strings], float)
            times = Counter()
            for s, w in zip(strings, weights):
                for i in range(len(s) - length + 1):
                    times[s[i : i + length]] += w
            for s, mark in zip(strings, suffixes.repeated(strings, weights, length)):
                assert mark.tolist() == [times[s[i : i + length]] >= 2 for i in range(len(s) - length + 1)]
