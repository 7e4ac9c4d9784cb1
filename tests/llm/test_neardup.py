"""The Jaccard join against all pairs."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from tidewell.llm import neardup, queries

SF = "/root/testdata/sf0.001"


def gram_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows):
    """doc -> (class, links, texts, copies); rows are (doc_id, text)."""
    sets = [gram_set(t) for _, t in rows]
    near = [[j for j in range(len(rows)) if j != i and sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])] for i in range(len(rows))]
    root = list(range(len(rows)))
    for _ in rows:
        new = [min([root[i], *(root[j] for j in near[i])]) for i in range(len(rows))]
        if new == root:
            break
        root = new
    group = defaultdict(list)
    for i, r in enumerate(root):
        group[r].append(rows[i][0])
    least = {r: min((x is None, x or 0) for x in own) for r, own in group.items()}
    out = []
    for i in range(len(rows)):
        low = least[root[i]]
        out.append((rows[i][0], None if low[0] else low[1], len(near[i]), len({sets[j] for j in near[i]} - {sets[i]}), max(1, sum(sets[j] == sets[i] for j in near[i]) + 1)))
    return sorted(out, key=repr)


def got(df):
    rows = df.collect()
    stays = defaultdict(int)
    for r in rows:
        stays[r.class_id] += r.stays
    assert set(stays.values()) <= {1} or None in stays
    return sorted(((r.doc_id, r.class_id, r.n_links, r.n_texts, r.n_copies) for r in rows), key=repr)


def test_whole_table_against_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert got(queries.op4_jaccard_join(spark, SF)) == brute(rows)


@pytest.fixture(scope="module")
def awkward():
    pick = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    base = pick.choices(words, k=120)
    texts = [None, "", "  ", "a b", "a  b", "a b c", "a b\nc", *["same text of six short words"] * 5]
    for _ in range(60):  # a large group of near copies, as chains
        own = list(base)
        own[pick.randrange(len(own))] = pick.choice(words)
        if pick.random() < 0.3:
            own[pick.randrange(len(own))] = pick.choice(words)
        texts.append(" ".join(own))
    texts += [" ".join(pick.choices(words, k=pick.randrange(1, 60))) for _ in range(30)]
    texts += [" ".join(pick.choices(words, k=9000))] * 2
    return [(i, t) for i, t in enumerate(texts)] + [(None, texts[20]), (None, "alone in the null"), (7, texts[7]), (7, "another text of the same key")]


@pytest.mark.parametrize("block", [512, 7])
def test_awkward_rows(spark, awkward, block, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", block)
    docs = spark.createDataFrame([(i, t, 1, "u") for i, t in awkward], "doc_id long, text string, uid int, k1 string")
    ours, theirs = got(neardup.join(docs)), brute(awkward)
    assert [r for r in ours if r[0] is not None] == [r for r in theirs if r[0] is not None] and len(ours) == len(theirs)
    assert got(neardup.join(docs.limit(0))) == []


def test_least_matches_is_the_posterior():
    least, rng = neardup.least_matches(0.8, 16, 1e-3), np.random.default_rng(1)
    for m in range(17):
        reach = (rng.beta(m + 1, 17 - m, 400_000) >= 0.8).mean()
        if abs(reach - 1e-3) > 4e-4:
            assert (m >= least[16]) == (reach >= 1e-3)


@pytest.mark.parametrize("again", [0, 1, 3])
def test_keep_one_keeps_all_rows_without_words(spark, again):
    same = " ".join(f"w{i}" for i in range(30))
    rows = [(1, ""), (1, ""), (None, None), (None, None), (5, " "), (3, "x y z")] + [(2, same)] * again + [(4, same)] * bool(again)
    kept = neardup.keep_one(spark.createDataFrame([(*r, "e") for r in rows], "doc_id long, text string, class_id string").repartition(3))
    expected = [(1, ""), (1, ""), (None, None), (None, None), (5, " "), (3, "x y z")] + [(2, same)] * bool(again)
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(expected, key=repr)
