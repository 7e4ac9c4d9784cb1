"""The one-pass lexicon against a search for every term, on default and test vocabularies and awkward texts."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewell import lexicons as L
from tidewell.functions import lexicon as LX
from tidewell.functions import text as X
from tidewell.operators import classify, importance
from tidewell.plans import pipeline, registry
from tidewell.plans.tables import AS_OF, items
from tidewell.schema import conform

SF = "/root/testdata/sf0.001"


def awkward(spark):
    """Items of default terms, joined in ways that make them touch, overlap and cross the fields' borders."""
    pick, terms = random.Random(3), [t for t in classify.lexicon().terms]
    say = lambda n: pick.choice(["", " ", "-"]).join(pick.choice(terms) for _ in range(pick.randrange(n)))
    rows = [(i, say(4).title(), say(60), pick.choice([None, say(9)]), pick.choice(["arXiv cs", "OpenAI Blog", say(3), None]), "https://" + say(2), pick.choice([None, "", say(2)])) for i in range(120)]
    rows += [(900, None, None, None, None, None, None), (901, "", "ai" * 40, "", "", "", ""), (902, "not not", "release not", None, "", "", "ceo"), (903, "İstanbul ΣΑΣ AI", "ΟΔΟΣ. GPT-4 Ai", "ἄλφα", "x", "y", "z")]
    return conform(spark.createDataFrame(rows, "ord long, title string, summary string, description string, source string, url string, author string"))


def test_scan_counts_without_overlaps(spark):
    lex = LX.Lexicon(["aa", "aba", "b a", "x"], ["aa", "zz"], placed=["aba"])
    assert lex.terms == ("aa", "aba", "b a", "x", "zz") and lex.name != LX.Lexicon(["aa", "aba", "b a", "x", "zz"]).name
    got = LX.scan(lex.terms, lex.placed, [["aaab"], ["ababa aaa"], ["x"], ["aaaa"], [""]], np.array([4])).to_pylist()[0]
    by = {lex.terms[h["term"]]: h for h in got}
    assert [by["aa"][p] for p in LX.PARTS] == [1, 1, 2, 3, 1, 2, 0, 2, 2, 0] and by["aa"]["first"] == 0 and by["aa"]["places"] == []
    assert (by["aba"]["summary"], by["aba"]["text"], by["aba"]["places"], by["b a"]["full"], by["b a"]["title"], by["b a"]["first"]) == (1, 1, [5, 7], 1, 0, 3)
    assert by["x"]["source"] == by["x"]["body"] == by["x"]["name"] == 1 and by["x"]["full"] == 0 and by["x"]["first"] is None
    assert LX.scan(lex.terms, lex.placed, [[""], [""], [""], [""], [""]], np.array([0])).to_pylist() == [[]]
    assert LX.scan((), lex.placed, [["a"]] * 5, np.array([0])).to_pylist() == [[]]
    with pytest.raises(ValueError):
        LX.Lexicon(["a", ""])


def _batch(n):
    pick = random.Random(8)
    say = lambda k: "".join(pick.choices("abc ", k=k))
    rows = [(say(8), say(pick.choice([0, 3, 400])), "s", "u", "") for _ in range(n)]
    return (*[pa.array(c, pa.string()) for c in zip(*rows, strict=True)], pa.array([1] * n, pa.int32()))


def test_slices_of_a_batch_are_its_scan():
    terms, placed, batch = ("ab", "aa", "c a", "bcb"), np.array([True, False, True, False]), _batch(60)
    whole = LX.scan(terms, placed, [c.to_pylist() for c in batch[:-1]], np.ones(60, np.int64))
    for size in (1, 500, 10**6):
        parts = list(LX.sliced(terms, placed, batch, size))
        assert pa.concat_arrays(parts).to_pylist() == whole.to_pylist() and (len(parts) == 60 if size == 1 else len(parts) == 1 if size == 10**6 else 1 < len(parts) < 60)
    assert [x.to_pylist() for x in LX.sliced(terms, placed, tuple(c.slice(0, 0) for c in batch))] == [[]]


def test_memory_of_a_scan_does_not_grow_with_the_batch():
    def peak(n):
        batch = _batch(n)
        tracemalloc.start()
        for _ in LX.sliced(("ab", "aa", "c a", "a", "b", "c"), np.zeros(6, bool), batch, 20_000):
            pass
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most

    peak(100)
    assert peak(8000) < 1.5 * peak(2000)


def test_memory_of_a_scan_is_that_of_its_arrays():
    tracemalloc.start()
    got = LX.scan(("a", "b"), np.zeros(2, bool), [[""], ["ab" * 100_000], [""], [""], [""]], np.ones(1, np.int64))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [h["full"] for h in got.to_pylist()[0]] == [100_000, 100_000] and most < 140 * 200_000


@pytest.mark.parametrize("which", ["default", "test"])
def test_every_scorer_equals_a_search_for_every_term(spark, which):
    v = classify.Vocabulary() if which == "default" else registry.VOCABULARY
    rows = classify.with_text(awkward(spark) if which == "default" else items(spark, SF), v).cache()
    lex = classify.lexicon(v)
    texts = {"title": F.col("_title"), "full": F.col("_full"), "summary": F.col("_summary"), "twice": F.concat_ws(" ", "_title", "_title", "_summary"), "body": F.concat_ws(" ", "_title", "_summary", "_source"), "source": F.col("_source"), "author": F.col("_author"), "name": F.concat_ws(" ", "_source", "_url"), "text": F.concat_ws(" ", "_title", F.lower(F.coalesce("summary", F.lit(""))))}
    ask = []
    for part in texts:
        a, b = lex.part(part), LX.Plain(texts[part])
        for terms in (v.types["product"] | v.core, L.AUTHORITY, {k: i for i, k in enumerate(v.priors) if k != "_default"}):
            pairs = [(a.any(terms), b.any(terms)), (a.count(terms), b.count(terms)), (F.round(a.weighted_score(terms), 9), F.round(b.weighted_score(terms), 9)), (a.largest(terms), b.largest(terms)), (a.first(terms), b.first(terms))]
            pairs.append((F.round(a.weight_sum(terms, lex.part("title"), 0.5), 9), F.round(b.weight_sum(terms, LX.Plain(F.col("_title")), 0.5), 9)))
            ask += [x.eqNullSafe(y) for x, y in pairs]
    ask.append(F.round(lex.part("full").negation(v.negations, v.actions), 9).eqNullSafe(F.round(X.negation(F.col("_full"), v.negations, v.actions), 9)))
    for i in range(0, len(ask), 60):
        wrong = rows.select(F.array_position(F.array(*ask[i : i + 60]), False).alias("w"), "ord").where("w > 0").collect()
        assert wrong == []
    rows.unpersist()


def test_importance_scans_for_itself_or_reads_the_shared_scan(spark):
    shared = pipeline.labelled(awkward(spark), AS_OF).select("ord", "importance", "importance_breakdown")
    alone = importance.score(classify.labelled(awkward(spark)), AS_OF).select("ord", "importance", "importance_breakdown")
    assert sorted(shared.collect()) == sorted(alone.collect()) and shared.count() == 124
