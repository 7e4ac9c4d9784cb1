"""Quality rules: a decision list learned by sequential covering, emitted as Spark conditional expressions.

`statistics` reads every whole text once and gives counts; `FEATURES` are ratios of them, as Spark columns.
`learn` covers the rows labelled bad one rule at a time: a rule grows on two thirds of the rows by the
threshold with the largest information gain, is pruned to the best of its parts (any conditions may go) on the other
third, and is kept if it is right at `PRECISION` there at least, so that clean documents stay. A rule has at most
`CONDITIONS` conditions and a list at most `RULES` rules. `verdict` turns the ordered rules into one
`CASE WHEN` over the features, inside whole-stage code generation.

At most `SAMPLE` labelled rows teach (picked by a hash of the key). No shuffle but for the join of that
bounded sample.

Cases: a null or empty text has zero counts and fails the base rule; features of empty texts are 0; labels
that are null, or keys without a document, do not teach; a key labelled twice counts as bad if either says so; of a key
with several texts the one with the smallest hash teaches;
without labels no learned rule applies; repeated rows get equal verdicts; extra columns do not matter; an
empty table gives no rows; a very long text counts whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import trimmed

SAMPLE, PRECISION, LEAST, CUTS, RULES, CONDITIONS = 6000, 0.97, 8, 40, 12, 4
WORD, UPPER = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[A-ZÀ-ÖØ-Þ]")
SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_digits")
RATIOS = {
    "words": ("n_words", None),
    "mean_word": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeated": ("n_repeat_words", "n_words"),
    "upper": ("n_upper", "word_chars"),
    "marks_per_word": ("n_marks", "n_words"),
    "digits": ("n_digits", "word_chars"),
    "words_per_line": ("n_words", "n_lines"),
}
FEATURES = tuple(RATIOS)


def repeat_words(words: list[str]) -> int:
    """Words inside three-word windows that occur twice or more."""
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    m = len(number)
    if len(ids) < 4:
        return 0
    two = ids[:-1] * m + ids[1:]
    if m > 1_000_000:
        two = np.unique(two, return_inverse=True)[1]
    _, which, times = np.unique(two[:-1] * m + ids[2:], return_inverse=True, return_counts=True)
    if len(times) == len(which):
        return 0
    start = np.flatnonzero(times[which] > 1)
    hit = np.zeros(len(ids), bool)
    for i in range(3):
        hit[start + i] = True
    return int(hit.sum())


def counts(text: str | None) -> tuple[int, ...]:
    if not text:
        return (0,) * len(COUNTS)
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    repeated = repeat_words(words)
    upper = len(UPPER.findall(text))
    digits = sum(map(text.count, "0123456789"))
    return (len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated, len(lines), upper, text.count("!"), digits)


def statistics(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`keep` columns of every row (all by default) and `COUNTS` of its whole text."""
    names = [c for c in (docs.columns if keep is None else keep) if c not in COUNTS]
    schema = ", ".join([*(f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in names), *(f"{c} long" for c in COUNTS)])
    at = names.index(text) if text in names else len(names)

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            got = np.array([counts(t.as_py()) for t in rb.column(at)], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([*rb.columns[: len(names)], *(pa.array(got[:, i]) for i in range(len(COUNTS)))], [*names, *COUNTS])

    own = [] if at < len(names) else [F.col(text).cast("string").alias("__text")]
    return docs.select(*[F.col(f"`{n}`") for n in names], *own).mapInArrow(run, schema)


def feature(name: str) -> Column:
    top, bottom = RATIOS[name]
    return F.col(top).cast("double") if bottom is None else F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom)).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    at: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.at if self.above else x[self.feature] <= self.at

    def column(self) -> Column:
        return feature(self.feature) > F.lit(self.at) if self.above else feature(self.feature) <= F.lit(self.at)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.at:.6g}"


def covered(rule: list[Condition], x: dict[str, np.ndarray], n: int) -> np.ndarray:
    hit = np.ones(n, bool)
    for c in rule:
        hit &= c.holds(x)
    return hit


def grow(x: dict[str, np.ndarray], bad: np.ndarray, rows: np.ndarray, names: list[str]) -> list[Condition]:
    """Adds the condition with the largest gain (bad rows kept, times bits won) until only bad rows are covered."""
    rule: list[Condition] = []
    hit = rows.copy()
    while bad[hit].any() and not bad[hit].all() and len(rule) < CONDITIONS:
        p0, best = bad[hit].mean(), (0.0, None)
        for name in names:
            v = x[name]
            values = np.unique(v[hit])
            cuts = np.unique(np.searchsorted(values, np.quantile(v[hit], np.linspace(0, 1, CUTS), method="lower")))
            cuts = cuts[cuts < len(values) - 1]
            for at in ((values[cuts] + values[cuts + 1]) / 2).tolist():  # midway between seen values
                for above in (True, False):
                    own = hit & ((v > at) if above else (v <= at))
                    p, n = int((own & bad).sum()), int(own.sum())
                    if p >= LEAST and n and (gain := p * (np.log2(p / n) - np.log2(p0))) > best[0] + 1e-9:
                        best = (gain, Condition(name, above, at))
        if best[1] is None:
            break
        rule.append(best[1])
        hit &= best[1].holds(x)
    return rule


def prune(rule: list[Condition], x: dict[str, np.ndarray], bad: np.ndarray, rows: np.ndarray) -> list[Condition]:
    def worth(r: list[Condition]) -> tuple[float, int]:
        hit = covered(r, x, len(bad)) & rows
        p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
        return ((p - 2 * n) / (p + n) if p + n else -2.0, p)

    parts = ([c for i, c in enumerate(rule) if keep >> i & 1] for keep in range(1, 1 << len(rule)))
    return max(sorted(parts, key=len), key=worth, default=[])  # of equals the shortest


def learn(x: dict[str, np.ndarray], bad: np.ndarray, seed: int = 3) -> list[list[Condition]]:
    """The ordered rules; a document that any rule covers is bad."""
    rules, left, names = [], np.ones(len(bad), bool), list(FEATURES)
    part = np.random.default_rng(seed).permutation(len(bad)) % 3
    while bad[left].sum() >= 2 * LEAST and len(rules) < RULES and names:
        growing, pruning = left & (part > 0), left & (part == 0)
        rule = prune(grow(x, bad, growing, names), x, bad, pruning)
        if not rule:
            break
        hit = covered(rule, x, len(bad)) & left
        held = hit & (part == 0)
        if hit.sum() < LEAST or bad[hit].mean() < PRECISION or (held.any() and bad[held].mean() < PRECISION - 0.05):
            names.remove(rule[0].feature)  # not sure enough: grow from another feature
            continue
        rules.append(rule)
        left &= ~hit
    return rules


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> list[list[Condition]]:
    """Rules learned from the labelled texts that pass the base rule: what it fails already needs no rule, and a rule for
    that could change nothing."""
    own = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.min(label).alias("y"))
    picked = own.orderBy(F.xxhash64(F.col("k").cast("string")), "k").limit(sample)
    texts = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(picked), "k")  # at most `sample` keys
    # Of a repeated key the text with the smallest hash teaches, however the table is partitioned.
    measured = statistics(texts.withColumn("h", F.xxhash64("t")), "t", ["k", "y", "h"]).where(~base_failed()).select("k", "h", F.struct("y", *[feature(f).alias(f) for f in FEATURES]).alias("x"))
    got = measured.groupBy("k").agg(F.min(F.struct("h", "x")).alias("m")).select("k", "m.x.*").collect()
    got.sort(key=lambda r: r.k)
    return learn({f: np.array([r[f] for r in got], float) for f in FEATURES}, np.array([r.y == 0 for r in got], bool)) if got else []


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def verdict(rules: list[list[Condition]]) -> Column:
    """False for the first rule that covers a row, true if none does."""
    out = None
    for rule in rules:
        when = rule[0].column()
        for c in rule[1:]:
            when = when & c.column()
        out = F.when(when, F.lit(False)) if out is None else out.when(when, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def judge(docs: DataFrame, rules: list[list[Condition]], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`keep` columns (but those named like new ones), the counts, base_failed and kept."""
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("base_failed", "kept")]
    return statistics(docs, text, names).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def keep_good(docs: DataFrame, rules: list[list[Condition]], text: str = "text") -> DataFrame:
    """The rows of `docs` that are kept, with their own columns."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("own"), F.col(text).alias("text"))
    kept = judge(packed, rules).where("kept")
    return kept.select(*[F.col("text").alias(text) if c == text else F.col(f"own.`{c}`") for c in docs.columns])
