"""Language identification by held-out accuracy; quality counts and rules by brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import langid, quality, queries

SF = "/root/testdata/sf0.01"
ODD = [None, "", " ", "\n\n", "123 !!", "a", "one two three one two three", "x " * 30000, "#\n#\n\n#", "\x0b\x0c a\xa0b \u2003c"]


def test_held_out_accuracy_and_contract(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op7_language(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in held]) > 0.99
    assert np.mean([r.rejected for r in held]) < 0.02


FOREIGN = ["Все счастливые семьи похожи друг на друга, каждая несчастливая семья несчастлива по своему. Все смешалось в доме", "מה נשתנה הלילה הזה מכל הלילות שבכל הלילות אנו אוכלין חמץ ומצה הלילה הזה כולו מצה", "春は曙。やうやう白くなりゆく山際、少し明かりて、紫だちたる雲の細くたなびきたる。夏は夜。月の頃はさらなり。", "Zxqv wkjp qqzx vvkw jjxq zkqw pxqv wzkj qxzv kkwj xqzp vwqk zjxq wkvq"]


def test_calibration_has_an_inner_optimum_and_rejects_what_is_foreign(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    assert 2e-4 < model.temperature < 500 and 0 < model.threshold < 1 and np.isfinite(model.familiar)
    assert all(model.predict(t)[2] for t in FOREIGN)
    rows = [r for r in docs.where(langid.held_out(F.col("doc_id"))).collect() if r.text and r.lang]
    assert np.mean([model.predict(r.text)[2] for r in rows]) < 0.02


def test_predictions_by_brute_force(spark):
    """The prediction restated n-gram by n-gram."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))

    def slow(text):
        if not text or not any(c.isalpha() for c in text):
            return "und", 0.0
        plain = re.sub(r"[\W\d_]+", " ", text.lower()).strip()
        data, total, n = f" {plain} ".encode(), np.zeros(len(model.languages)), 0
        for size in (2, 3, 4):
            for i in range(len(data) - size + 1):
                code = data[i]
                for b in data[i + 1 : i + size]:
                    code = (code * 0x01000193 + b * 0x9E3779B1) & 0xFFFFFFFF
                total += model.table[((((code ^ code >> 15) * 0x85EBCA6B) + size) & 0xFFFFFFFF) >> 16][:-1]
                n += 1
        x = (total / n + model.bias) / model.temperature
        e = np.exp(x - x.max())
        return model.languages[int(x.argmax())], float((e / e.sum()).max())

    some = docs.where("doc_id % 11 = 3 and length(text) < 3000")
    texts = {r.doc_id: r.text for r in some.collect()}
    for r in langid.identify(some, model).collect():
        lang, score = slow(texts[r.doc_id])
        assert r.lang_pred == lang and abs(r.score - score) < 1e-3


def test_rare_languages_are_learned(spark):
    rows = [(i, "the of and to that it was", "en") for i in range(400)] + [(1000 + i, "und der die nicht ein ist", "de") for i in range(3)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=20)
    assert model.languages == ["de", "en"]


def test_odd_texts_and_empty_tables(spark):
    model = langid.train([("the of and to that", "en"), ("der die und nicht ein", "de")] * 40)
    docs = spark.createDataFrame([(t, i, "en", 0.5) for i, t in enumerate(ODD)], "text string, doc_id long, lang_pred string, score double")
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert [i for i, r in got.items() if r.lang_pred == "und"] == [0, 1, 2, 3, 4, 8] and all(r.rejected for r in got.values() if r.lang_pred == "und")
    assert model.predict("und die der") [0] == "de"
    empty = docs.limit(0).withColumn("lang", F.lit("x"))
    assert langid.identify(empty, langid.fit(empty)).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, langid.fit(docs.withColumn("lang", F.lit(None).cast("string")))).collect()} == {"und"}


def test_partitioning_does_not_change_the_model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    a, b = (langid.fit(docs.repartition(n), sample=100) for n in (1, 7))
    assert (a.table == b.table).all() and a.threshold == b.threshold


def slow_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    inside = {i + j for i in range(len(words) - 2) for j in range(3) if windows[tuple(words[i : i + 3])] > 1}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(inside)


def test_counts_by_brute_force(spark):
    pick = random.Random(8)
    texts = ODD + ["".join(pick.choices(["a ", "b ", "c\n", "# ", "a\n", "\t", "zz "], k=pick.randrange(80))) for _ in range(300)]
    docs = spark.createDataFrame([(t, i, 7) for i, t in enumerate(texts)], "text string, doc_id long, n_words int")
    for r in quality.statistics(docs).collect():
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == slow_counts(texts[r.doc_id])
    assert quality.statistics(docs.limit(0)).count() == 0


def test_rules_keep_clean_documents_and_catch_bad_ones(spark):
    got = {r.doc_id: r for r in queries.op9_quality(spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    for r in got.values():
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
    judged = [(y.quality, got[y.doc_id].kept) for y in labels if not got[y.doc_id].base_failed]
    assert np.mean([kept for y, kept in judged if y == 1]) > 0.99
    assert np.mean([kept for y, kept in judged if y == 0]) < 0.2


@pytest.mark.parametrize("rule", [[], [[quality.Condition("digits", True, 0.1)], [quality.Condition("words", False, 3.0), quality.Condition("marks_per_word", True, 0.5)]]])
def test_emitted_expression_equals_the_list(spark, rule):
    docs = spark.createDataFrame([(t, i) for i, t in enumerate([*ODD, "1234", "a !", "a b c d !!!!"])], "text string, doc_id long")
    rows = quality.judge(docs, rule).select("*", *[quality.feature(f).alias(f"f_{f}") for f in quality.FEATURES]).collect()
    x = {f: np.array([r[f"f_{f}"] for r in rows]) for f in quality.FEATURES}
    bad = np.any([quality.covered(r, x, len(rows)) for r in rule], axis=0) if rule else np.zeros(len(rows), bool)
    assert [r.kept for r in rows] == [not r.base_failed and not b for r, b in zip(rows, bad)]


def test_a_condition_that_adds_nothing_goes():
    rng = np.random.default_rng(1)
    x = {f: rng.random(900) for f in quality.FEATURES}
    bad = x["digits"] > 0.8
    rule = [quality.Condition("upper", True, -1.0), quality.Condition("digits", True, 0.8)]
    assert quality.prune(rule, x, bad, np.ones(900, bool)) == rule[1:]


def test_repeated_keys_teach_alike(spark):
    pick = random.Random(3)
    word = lambda bad: str(pick.randrange(10**4)) if pick.random() < 0.3 * bad + 0.05 else "".join(pick.choices("abcdef", k=4))
    rows = [(" ".join(word(bad) for _ in range(80)), i) for i in range(90) for bad in (i % 2, i % 2)]
    docs = spark.createDataFrame(rows, "text string, doc_id long")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(90)], "doc_id long, quality int")
    found = [quality.fit(docs.repartition(n), labels) for n in (1, 5, 9)]
    assert found[0] == found[1] == found[2] != []


def test_every_rule_changes_a_verdict(spark):
    """Rules are learned behind the base rule: each one alone covers documents that the base rule keeps and no rule before it covers."""
    docs, labels = (spark.read.parquet(f"{SF.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    rules = quality.fit(docs, labels)
    rows = quality.judge(docs, []).where("kept").select(*[quality.feature(f).alias(f) for f in quality.FEATURES]).collect()
    x, left = {f: np.array([r[f] for r in rows]) for f in quality.FEATURES}, np.ones(len(rows), bool)
    for rule in rules:
        hit = quality.covered(rule, x, len(rows)) & left
        assert hit.any()
        left &= ~hit
    assert rules


def test_thresholds_move_with_the_share_that_may_be_lost():
    rows = [(" ".join(random.Random(i).choices("the of and to that it was for on are".split() if i % 2 else "der die und nicht ein ist das mit auf von".split(), k=6)), "en" if i % 2 else "de") for i in range(300)]
    model, at = langid.train(rows), []
    for lost in (0.0, 0.001, 0.002, 0.1, 0.4):
        langid.calibrate(model, rows, {"de": 0, "en": 1}, lost)
        at.append((model.threshold, model.familiar))
    assert at == sorted(at) and len(set(at)) == 5


def test_no_labels(spark):
    docs = spark.createDataFrame([("w " * 60, 1)], "text string, doc_id long")
    assert quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int")) == []
    assert quality.fit(docs, spark.createDataFrame([(None, 1), (9, 0), (1, None)], "doc_id long, quality int")) == []
