"""Human review: queue, decisions, audit, and what reviews teach."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.lexicons import COMMON_WORDS, REVIEW_TECH
from tidewell.operators.dedup import ranked_first
from tidewell.schema import keys


def queue(items: DataFrame, least: float = 0.6, limit: int | None = None) -> DataFrame:
    out = items.where((F.coalesce("confidence", F.lit(1.0)) < least) | F.coalesce("needs_review", F.lit(False)))
    return out if limit is None else out.orderBy("ord").limit(limit)


def tech_fields(entered: Column, known: tuple = REVIEW_TECH) -> Column:
    """Fields from what a reviewer entered: numbers of the list of known ones, or names. Null if nothing is left."""
    parts = F.transform(F.split(F.trim(entered), ","), lambda t: F.trim(t))
    numbers = F.filter(F.transform(parts, lambda t: t.try_cast("int")), lambda i: i.between(1, len(known)))
    named = F.transform(numbers, lambda i: F.element_at(F.array(*map(F.lit, known)), i))
    numeric = F.forall(parts, lambda t: t.rlike(r"^[+-]?[0-9]+$"))
    return F.when(F.trim(entered) == "", None).when(numeric, F.when(F.size(named) > 0, named)).otherwise(parts)


def ordered(decisions: DataFrame, on: str) -> DataFrame:
    """Decisions (item or ord, action, value, seq): `seq` orders the decisions on one item; without it they go by action and value."""
    seq = F.col("seq") if "seq" in decisions.columns else F.lit(0).cast("long")
    return decisions.select(on, "action", "value", F.struct(seq.alias("seq"), "action", "value").alias("seq"))


def apply(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions (item, as the queue has it, or else ord; action, value, and seq where one item has several) on items: confirm, category, tech, region, spam,
    skip. All decisions on an item count, in their order: of one kind the last gives the value. Confirming and a new
    category settle the review; a new category keeps the one before it beside it."""
    on = keys(items, decisions)
    d, is_ = ordered(decisions, on), lambda *a: F.col("action").isin(*a)
    last = lambda a: F.max_by(F.when(is_(a), F.col("value")), F.when(is_(a), F.col("seq")))
    before = F.lag("value").over(Window.partitionBy(on, "action").orderBy("seq"))
    folded = d.withColumn("_before", F.when(is_("category"), before)).groupBy(on).agg(
        F.max(is_("category")).alias("_moved"), last("category").alias("_type"), F.max_by(F.when(is_("category"), F.struct("_before")), F.when(is_("category"), F.col("seq")))["_before"].alias("_was"),
        F.max(is_("tech")).alias("_retech"), last("tech").alias("_tech"), F.max(is_("region")).alias("_placed"), last("region").alias("_region"),
        F.max(is_("confirm", "category")).alias("_settled"), F.max(is_("confirm", "category", "tech", "region", "spam")).alias("_reviewed"), F.max(is_("spam")).alias("_spam"),
    )
    out, yes = items.join(folded, on, "left"), lambda c: F.coalesce(c, F.lit(False))
    values = {
        "original_category": F.when(F.col("_moved"), F.coalesce("_was", "content_type")),
        "original_confidence": F.when(F.col("_moved"), F.when(F.col("_was").isNotNull(), 1.0).otherwise(F.col("confidence"))),
        "content_type": F.when(F.col("_moved"), F.col("_type")).otherwise(F.col("content_type")),
        "confidence": F.when(F.col("_moved"), 1.0).otherwise(F.col("confidence")),
        "tech_categories": F.coalesce(F.when(F.col("_retech"), tech_fields(F.col("_tech"))), F.col("tech_categories")),
        "region": F.when(F.col("_placed"), F.col("_region")).otherwise(F.col("region")),
        "needs_review": F.when(F.col("_settled"), False).otherwise(F.coalesce("needs_review", F.lit(False))),
        "manually_reviewed": yes(F.col("_reviewed")),
        "is_spam": yes(F.col("_spam")),
    }
    return out.withColumns(values).drop(*[c for c in folded.columns if c != on])


def without_spam(items: DataFrame) -> DataFrame:
    return items.where(~F.coalesce("is_spam", F.lit(False)))


def audit(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """(ord, title, action) log rows, as the review history has them."""
    on = keys(items, decisions)
    d = ordered(decisions, on).where("action <> 'skip'")
    d = d.withColumn("_before", F.lag("value").over(Window.partitionBy(on, "action").orderBy("seq")))  # what the last change left
    text = (
        F.when(F.col("action") == "confirm", F.lit("Confirmed"))
        .when(F.col("action") == "category", F.concat(F.lit("Category: "), F.coalesce("_before", "content_type", F.lit("unknown")), F.lit(" -> "), F.col("value")))
        .when(F.col("action") == "spam", F.lit("Marked spam"))
        .otherwise(F.concat(F.initcap("action"), F.lit(": "), F.col("value")))
    )
    return d.join(items.select(*dict.fromkeys([on, "ord", "title", "content_type"])), on).select("ord", "title", text.alias("action"))


def action_summary(log: DataFrame) -> DataFrame:
    return log.groupBy(F.split_part("action", F.lit(":"), F.lit(1)).alias("action")).agg(F.count("*").alias("n"))


def transitions(log: DataFrame) -> DataFrame:
    """(was, becomes, n) of category changes."""
    moved = log.where(F.col("action").startswith("Category: ")).withColumn("_p", F.split(F.substring("action", 11, 1000), " -> "))
    return moved.select(F.element_at("_p", 1).alias("was"), F.try_element_at("_p", F.lit(2)).alias("becomes")).groupBy("was", "becomes").agg(F.count("*").alias("n"))


def statistics(log: DataFrame) -> DataFrame:
    starts = lambda x: F.count_if(F.col("action").startswith(x))
    return log.agg(F.count("*").alias("total"), starts("Confirmed").alias("confirmed"), starts("Marked spam").alias("spam"), starts("Category: ").alias("corrected"))


def weight_adjustments(log: DataFrame, pair: int = 3, source: int = 5) -> DataFrame:
    """Categories whose terms should weigh less or more: frequent transitions, and categories that are often left."""
    t = transitions(log)
    frequent = t.where(F.col("n") >= pair).select(F.lit("transition").alias("rule"), "was", "becomes", "n")
    left = t.groupBy("was").agg(F.sum("n").alias("n")).where(F.col("n") >= source).select(F.lit("left").alias("rule"), "was", F.lit(None).cast("string").alias("becomes"), "n")
    return frequent.unionByName(left)


def mined_words(reviewed: DataFrame, n: int = 10, common: tuple = COMMON_WORDS) -> DataFrame:
    """The most frequent words of each content type among reviewed items; ties in order of the words."""
    text = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit(""))))
    words = F.filter(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]{3,}"), F.lit(0)), lambda w: ~w.isin(*common))
    per = reviewed.where("manually_reviewed").select("content_type", F.explode(words).alias("word")).groupBy("content_type", "word").agg(F.count("*").alias("n"))
    return ranked_first(per, ["content_type"], [F.desc("n"), F.col("word")], n)


def suggestions(reviewed: DataFrame, known: DataFrame, n: int = 5) -> DataFrame:
    """Mined words that the vocabulary (content_type, word) lacks."""
    fresh = mined_words(reviewed).drop("rank").join(known, ["content_type", "word"], "left_anti")
    return ranked_first(fresh, ["content_type"], [F.desc("n"), F.col("word")], n)


def error_patterns(reviewed: DataFrame, confirmed: int = 3, corrected: int = 2) -> DataFrame:
    """Where confidence misleads, over all reviewed rows: (pattern, n) of unsure ones that kept their category and sure ones that lost it."""
    moved = F.col("original_category").isNotNull()
    unsure, sure = (F.coalesce("confidence", F.lit(1.0)) < 0.6) & ~moved, (F.coalesce("original_confidence", F.lit(1.0)) > 0.7) & moved
    counts = reviewed.where("manually_reviewed").agg(F.count_if(unsure).alias("unsure"), F.count_if(sure).alias("sure"))
    rows = F.array(*[F.struct(F.lit(p).alias("pattern"), F.col(c).alias("n"), F.lit(least).alias("least")) for p, c, least in (("threshold_adjustment", "unsure", confirmed), ("false_positive", "sure", corrected))])
    return counts.select(F.inline(rows)).where("n >= least").select("pattern", "n")


def learning_summary(log: DataFrame, reviewed: DataFrame) -> DataFrame:
    return statistics(log).crossJoin(F.broadcast(reviewed.agg(F.count_if("manually_reviewed").alias("reviewed"))))
