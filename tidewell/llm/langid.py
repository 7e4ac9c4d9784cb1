"""Language identification: averaged hashed subword embeddings, a linear softmax, calibrated rejection.

A text's features are the hashed byte n-grams (`GRAMS`) of its words, each word between two blanks, in lower
case, with everything but letters as blanks. Their embeddings are averaged and a linear layer gives one score
per language; both are trained together by stochastic gradient descent in numpy. Since averaging and the layer
are linear, a trained model is one table of a score per bucket and language.

Training uses the `SAMPLE` labelled rows with the smallest hashes of their keys, and the first `RARE` of every label, so
that a rare language is learned too; the choice is the same however the table is partitioned. A fifth of them calibrate:

* a temperature is fitted to them, with targets smoothed by their number, so it has an inner optimum even where all are
  right;
* a text is rejected if its best language is less sure than that of nearly all rightly labelled ones, or if it
  looks less familiar than they do: the mean log share that its n-grams have in the training texts, given the benefit of
  two standard errors, so that a short text isn't rejected for chance alone. Both thresholds are quantiles, for half of
  `LOST` each, and nothing else.

Cases: a null, empty or letterless text is `und` with score 0 and is rejected; labels that are null do not
teach; ties between languages go to the first in order; repeated rows and extra columns do not matter; with
no labelled rows every text is `und`; an empty table gives no rows; a very long text counts whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import trimmed

BUCKETS, GRAMS, WIDTH, SAMPLE, RARE, LOST = 1 << 16, (2, 3, 4), 16, 4000, 50, 0.002
LETTER, NOT_LETTERS = regex.compile(r"\p{L}"), regex.compile(r"[^\p{L}\p{M}]+")


def features(text: str) -> np.ndarray:
    """Bucket of every n-gram of the whole text, in order, repeats included."""
    data = np.frombuffer(f" {NOT_LETTERS.sub(' ', text.lower()).strip()} ".encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    out, code = [], data.copy()
    for n in range(1, max(GRAMS) + 1):
        if n > 1:
            code = code[:-1] * np.uint32(0x01000193) + data[n - 1 :] * np.uint32(0x9E3779B1)
        if n in GRAMS and len(code):
            mixed = (code ^ (code >> np.uint32(15))) * np.uint32(0x85EBCA6B) + np.uint32(n)
            out.append(mixed >> np.uint32(16))
    return np.concatenate(out) if out else np.empty(0, np.uint32)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # a row per bucket: a score per language, and the log of the bucket's share of the training texts
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0
    spread: float = 0.0  # of the log shares of single n-grams
    familiar: float = -np.inf

    def means(self, text: str) -> tuple[np.ndarray, float]:
        """(logits, familiarity): means of the rows of all n-grams; sums over runs bound memory for very long texts."""
        buckets = features(text)
        total = sum((self.table[buckets[i : i + 500_000]].sum(0, dtype=np.float64) for i in range(0, len(buckets), 500_000)), np.zeros(len(self.languages) + 1))
        n = max(1, len(buckets))
        return total[:-1] / n + self.bias, float(total[-1] / n + 2 * self.spread / np.sqrt(n))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, calibrated probability, rejected)."""
        if not self.languages or not text or not LETTER.search(text):
            return "und", 0.0, True
        logits, familiar = self.means(text)
        p = softmax(logits / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best]), bool(p[best] < self.threshold or familiar < self.familiar)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(rows: list[tuple[str, str]], epochs: int = 4, rate: float = 2.0, seed: int = 7) -> Model:
    """Fits embeddings and layer on four fifths of `rows` (text, language), calibrates on the rest."""
    rows = [(t, y) for t, y in rows if t and y and LETTER.search(t)]
    languages = sorted({y for _, y in rows})
    if not rows:
        return Model([], np.zeros((1, 1)), np.zeros(0))
    rng, code = np.random.default_rng(seed), {y: i for i, y in enumerate(languages)}
    bags = []
    for text, y in rows:
        buckets, counts = np.unique(features(text), return_counts=True)
        bags.append((buckets, counts / counts.sum(), code[y]))
    order = rng.permutation(len(bags))
    held, own = order[: len(bags) // 5], order[len(bags) // 5 :]
    weight = np.bincount([bags[i][2] for i in own], minlength=len(languages)).astype(float)
    weight = np.divide(weight.sum() / len(languages), weight, out=np.zeros_like(weight), where=weight > 0) ** 0.5
    embed, layer, bias = rng.normal(0, 1 / WIDTH, (BUCKETS, WIDTH)), np.zeros((WIDTH, len(languages))), np.zeros(len(languages))
    layer += rng.normal(0, 0.1, layer.shape)
    step, steps = 0, epochs * len(own)
    for _ in range(epochs):
        for i in rng.permutation(own):
            buckets, shares, y = bags[i]
            lr = rate * (1 - step / steps) * min(weight[y], 5.0)
            step += 1
            h = shares @ embed[buckets]
            error = softmax(h @ layer + bias)
            error[y] -= 1
            back = layer @ error
            layer -= lr * np.outer(h, error)
            bias -= 0.1 * lr * error
            # Each n-gram moves by its share of the text, scaled up so that sparse rows learn at the layer's pace.
            embed[buckets] -= lr * 50 * np.outer(shares, back)
    seen = np.full(BUCKETS, 1e-9)  # a bucket's share of the training texts
    for i in own:
        seen[bags[i][0]] += bags[i][1] / len(own)
    share = np.log(seen)
    model = Model(languages, np.column_stack([embed @ layer, share]).astype(np.float32), bias)
    model.spread = float(np.sqrt(max(0.0, (seen * share**2).sum() / seen.sum() - ((seen * share).sum() / seen.sum()) ** 2)))
    calibrate(model, [rows[i] for i in (held if len(held) else own)], code)
    return model


def calibrate(model: Model, rows: list[tuple[str, str]], code: dict[str, int], lost: float = LOST) -> None:
    means, y = [model.means(t) for t, _ in rows], np.array([code[x] for _, x in rows])
    logits, familiar = np.array([m[0] for m in means]), np.array([m[1] for m in means])
    target = np.full(logits.shape, 1 / (len(y) + 2) / max(1, logits.shape[1] - 1))
    target[np.arange(len(y)), y] = (len(y) + 1) / (len(y) + 2)
    loss = lambda t: float(-(target * np.log(softmax(logits / t) + 1e-300)).sum(1).mean())
    model.temperature = float(min(np.geomspace(1e-4, 1e3, 400), key=loss))
    p = softmax(logits / model.temperature)
    right = p.argmax(1) == y
    if right.any():
        # Interpolated, so that a share under one row still moves with `lost`.
        model.threshold, model.familiar = (float(np.quantile(x[right], lost / 2)) for x in (p.max(1), familiar))


def crc32_mod(key: Column, n: int) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % n


def fit(docs: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", sample: int = SAMPLE, rare: int = RARE) -> Model:
    """A model of at most `sample` labelled rows and the first `rare` of each label. Hashes are picked first, so only the
    picked texts reach the driver."""
    named = docs.where(F.col(label).isNotNull()).select(F.col(text).cast("string").alias("t"), F.col(label).cast("string").alias("y"), F.xxhash64(F.col(key).cast("string")).alias("h"))
    cut = named.select("h").orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if cut is None:
        return train([])
    # Of a label with n rows about 4 * rare have so small a hash, so no label's rows meet in one task before they are few.
    share = F.least(F.lit(1.0), F.lit(4.0 * rare) / F.col("n"))
    # The labels may be broadcast: the model itself has a column for each, so they are few.
    sizes = F.broadcast(named.groupBy(F.col("y").alias("z")).agg(F.count("*").alias("n")))
    low = named.join(sizes, F.col("y") == F.col("z")).where(F.col("h").cast("double") <= share * 2.0**64 - 2.0**63)
    rank = F.row_number().over(Window.partitionBy("y").orderBy("h", F.xxhash64("t")))
    few = low.select("t", "y", "h").withColumn("r", rank).where(F.col("r") <= rare).where(F.col("h") > cut).select("t", "y", "h")
    got = named.where(F.col("h") <= cut).orderBy("h", "t", "y").limit(sample).unionByName(few).collect()
    got.sort(key=lambda r: (r.h, r.t or "", r.y))
    return train([(r.t, r.y) for r in got])


def identify(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, made: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """`keep` columns of every row (all but the text by default) and the three `made` ones, which replace columns of their names."""
    names = [c for c in ([c for c in docs.columns if c != text] if keep is None else keep) if c not in made]
    schema = ", ".join([*(f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in names), f"{made[0]} string, {made[1]} double, {made[2]} boolean"])
    at = names.index(text) if text in names else len(names)

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            got = [model.predict(t.as_py()) for t in rb.column(at)]
            new = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*rb.columns[: len(names)], *new], [*names, *made])

    own = [] if at < len(names) else [F.col(text).cast("string").alias("__text")]
    return docs.select(*[F.col(f"`{n}`") for n in names], *own).mapInArrow(run, schema)


def held_out(key: Column) -> Column:
    """True for the third of all keys that teaches nothing."""
    return F.coalesce(crc32_mod(key, 3) == 1, F.lit(False))
