"""Importance: five weighted dimensions, a relevance factor, and learned source authority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell import lexicons as L
from tidewell.functions import text as X
from tidewell.functions.lexicon import Lexicon, Part, matcher
from tidewell.sources.shared import Scratch

#: Weights of the dimensions.
WEIGHTS = {"source_authority": 0.25, "recency": 0.25, "confidence": 0.20, "relevance": 0.20, "engagement": 0.10}


LAYERS = ((L.BREAKTHROUGH, 1.0), (L.RELEASE, 0.9), (L.TECHNIQUE, 0.8), (L.GENERAL, 0.6))


def vocabularies() -> tuple[dict, ...]:
    """Terms that importance looks for."""
    return (*[terms for terms, _ in LAYERS], L.DOUBT, L.AUTHORITY)


def authority(text: Column | Part, table: dict = L.AUTHORITY, default: float = 0.40) -> Column:
    """The largest authority of a source name that the text contains."""
    return F.coalesce(F.greatest(matcher(text).largest(table), F.lit(default)), F.lit(default))


def blended(static: Column, count: Column, average: Column) -> Column:
    """Static authority with what reviews taught, once there are five."""
    w = F.least(F.lit(0.40), 0.20 + 0.02 * count)
    return F.when(F.coalesce(count, F.lit(0)) >= 5, static * (1 - w) + average * w).otherwise(static)


def recency(at: Column, now: Column, content_type: Column, decay: dict = L.DECAY, default: float = 0.12) -> Column:
    rate = F.coalesce(F.try_element_at(F.filter(X.weighted(decay), lambda t: t["term"] == content_type), F.lit(1))["weight"], F.lit(default))
    days = X.decay_days(at, now)
    return F.when(at.isNull(), 0.5).when(days <= 0, 1.0).otherwise(F.round((1 - 0.08) * F.exp(-rate * days) + 0.08, 3))


def relevance(title: Column | Part, text: Column | Part, content_type: Column, layers: tuple = LAYERS, doubt: dict = L.DOUBT, factors: dict = L.TYPE_FACTORS) -> Column:
    """Layered terms, each in its first layer only, less doubt, with a little more for terms in the title."""
    seen: set[str] = set()
    title, text = matcher(title), matcher(text)
    total, hits = F.lit(0.25), F.lit(0)
    for terms, factor in layers:
        own = {t: w for t, w in terms.items() if t not in seen}
        seen |= own.keys()
        total = total + text.weight_sum(own) * factor
        hits = hits + title.count(own)
    total = total + text.weight_sum(doubt) + F.least(F.lit(0.10), hits * 0.02)
    factor = F.coalesce(F.try_element_at(F.filter(X.weighted(factors), lambda t: t["term"] == content_type), F.lit(1))["weight"], F.lit(0.9))
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.1), total * factor)), 3)


def engagement(signals: dict[str, Column], scale: dict = L.ENGAGEMENT) -> Column:
    """Log-normalised signals over their weights, and a little more for several."""
    parts = []
    for name, value in signals.items():
        low, high, weight = scale[name]
        v = value.cast("double")
        norm = F.when(v < low, F.ln(v + 1) / F.ln(F.lit(low + 1.0)) * 0.4).otherwise(0.4 + 0.6 * F.ln(v / low + 1) / F.ln(F.lit(high / low + 1.0)))
        parts.append(F.when(v > 0, F.struct(F.least(norm * weight, F.lit(1.0)).alias("s"), F.lit(weight).alias("w"))))
    have = F.array_compact(F.array(*parts))
    total = lambda f: F.aggregate(have, F.lit(0.0), lambda acc, x: acc + x[f])
    score = total("s") / total("w") + 0.03 * F.least(F.size(have) - 1, F.lit(3))
    return F.when(F.size(have) == 0, 0.5).otherwise(F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)), 3))


def item_signals() -> dict[str, Column]:
    reddit = F.when(F.contains(F.lower(F.coalesce("source", F.lit(""))), F.lit("reddit")), F.col("score"))
    return {"stars": F.col("stars"), "downloads": F.col("downloads"), "reddit": reddit, "points": F.col("points"), "likes": F.col("likes"), "comments": F.col("comments")}


def capped(confidence: Column, recency_: Column, authority_: Column) -> Column:
    """Old items of weak sources are never sure."""
    return F.when((recency_ <= 0.56) & (authority_ < 0.70), F.least(confidence, F.lit(0.75))).when((recency_ > 0.56) & (recency_ <= 0.70) & (authority_ < 0.60), F.least(confidence, F.lit(0.85))).otherwise(confidence)


def factor(ai: Column) -> Column:
    return F.when(ai >= 0.8, 1.0 + 0.25 * (ai - 0.8)).when(ai >= 0.5, 0.85 + 0.5 * (ai - 0.5)).when(ai >= 0.3, 0.6 + 1.25 * (ai - 0.3)).otherwise(0.3 + ai)


def combined(parts: dict[str, Column], ai: Column) -> Column:
    total = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        total = total + parts[name] * weight
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total * factor(ai))), 3)


def level(importance: Column) -> Column:
    return F.when(importance >= 0.85, "critical").when(importance >= 0.70, "high").when(importance >= 0.55, "medium").when(importance >= 0.40, "low").otherwise("minimal")


def score(items: DataFrame, as_of: str, learned: DataFrame | None = None, lexicon: Lexicon | None = None) -> DataFrame:
    """importance, importance_level and importance_breakdown of classified items. `learned`: (source, n, average). `lexicon`: the
    one whose hits the items still have; without it they are scanned for importance's own terms."""
    now = F.lit(as_of).cast("timestamp")
    if lexicon is None:
        lexicon, low = Lexicon(*vocabularies()), lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
        items = items.withColumns({"_title": low("title"), "_summary": low("summary"), "_text": F.lit(0), "_source": low("source"), "_url": low("url"), "_author": F.lit("")})
        items = items.withColumn(lexicon.name, lexicon.column())
    out = items.drop("_source").withColumn("_auth", authority(lexicon.part("name")))
    if learned is not None:
        out = out.join(learned.select(F.lower("source").alias("_source"), F.col("n").alias("_n"), F.col("average").alias("_avg")), F.lower("source") == F.col("_source"), "left").withColumn("_auth", blended(F.col("_auth"), F.col("_n"), F.col("_avg")))
    ai = F.coalesce("ai_relevance", F.lit(0.7))
    out = out.withColumns({"_rec": recency(F.col("published_ts"), now, F.col("content_type")), "_rel": relevance(lexicon.part("title"), lexicon.part("text"), F.col("content_type")), "_eng": engagement(item_signals()), "_ai": ai})
    out = out.withColumn("_conf", capped(F.coalesce("confidence", F.lit(0.5)), F.col("_rec"), F.col("_auth")))
    parts = {"source_authority": F.col("_auth"), "recency": F.col("_rec"), "confidence": F.col("_conf"), "relevance": F.col("_rel"), "engagement": F.col("_eng")}
    breakdown = F.struct(*[c.alias(n) for n, c in parts.items()], F.col("_ai").alias("ai_relevance"), F.round(factor(F.col("_ai")), 3).alias("ai_multiplier"))
    out = out.withColumns({"importance": combined(parts, F.col("_ai")), "importance_breakdown": breakdown}).withColumn("importance_level", level(F.col("importance")))
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def rolling(feedback: DataFrame, last: int = 50, block_rows: int = 100_000) -> DataFrame:
    """Count and average of each source's last scores, at every score (source, seq, score); sources are told apart in lower case.

    A range sort and the sizes of its parts give each score its number within its source. Blocks of numbers are then windows
    of their own, each with the `last` - 1 scores before it, so one source of any size is spread over many tasks."""
    scratch = Scratch(feedback.sparkSession, "rolling")
    named = feedback.select(F.lower("source").alias("source"), "seq", "score")
    parts = scratch.table("parts", named.repartitionByRange("source", "seq", F.xxhash64("score")).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("source", "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    starts = sizes.select("source", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    same = F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a._part") == F.col("b._part"))
    own = F.row_number().over(Window.partitionBy("a.source", "a._part").orderBy("a.seq", F.xxhash64("a.score")))
    numbered = parts.alias("a").join(starts.alias("b"), same).select("a.source", "seq", "score", (F.col("_start") + own - 1).alias("_at"))
    block = F.floor(F.col("_at") / block_rows)
    seen = numbered.withColumn("_block", F.explode(F.when(F.col("_at") % block_rows > block_rows - last, F.array(block, block + 1)).otherwise(F.array(block))))
    w = Window.partitionBy("source", "_block").orderBy("_at").rowsBetween(1 - last, 0)
    out = seen.select("source", "seq", "_at", "_block", F.count("*").over(w).alias("n"), F.avg("score").over(w).alias("average"))
    return out.where(F.floor(F.col("_at") / block_rows) == F.col("_block")).select("source", "seq", "n", "average")


def learned_authority(feedback: DataFrame, last: int = 50) -> DataFrame:
    """(source, n, average) now: the state after each source's last score. Top rows by a bounded rank, which adaptive
    execution filters before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("seq")))
    return feedback.withColumn("source", F.lower("source")).withColumn("_r", rank).where(F.col("_r") <= last).groupBy("source").agg(F.count("*").alias("n"), F.avg("score").alias("average"))


def flagged(learned: DataFrame, least: int = 5) -> DataFrame:
    return learned.agg(F.count("*").alias("sources"), F.count_if(F.col("n") >= least).alias("learned"), F.coalesce(F.sum("n"), F.lit(0)).alias("scores"))
