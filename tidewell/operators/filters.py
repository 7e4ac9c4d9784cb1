"""Row filters, increments against history, and quotas."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell import lexicons as L
from tidewell.functions import text as X


def valid(items: DataFrame) -> DataFrame:
    return items.where((F.length("title") > 10) & (F.coalesce("url", F.lit("")) != ""))


def recent(items: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Items of the last days; those without a readable date stay."""
    limit = F.lit(as_of).cast("timestamp") - F.make_interval(days=F.lit(days))
    return items.where(F.coalesce(F.col("published_ts") >= limit, F.lit(True)))


def about(items: DataFrame, terms: tuple = L.TOPIC_TERMS, fields: tuple[str, ...] = ("title", "summary")) -> DataFrame:
    """Items with any of the terms in their fields."""
    return items.where(X.contains_any(F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in fields])), terms))


def faceted(items: DataFrame, content_type: str | None = None, tech: str | None = None, region: str | None = None) -> DataFrame:
    if content_type is not None:
        items = items.where(F.col("content_type") == content_type)
    if tech is not None:
        items = items.where(F.array_contains("tech_categories", tech))
    return items if region is None else items.where(F.col("region") == region)


def publishable(items: DataFrame, least: float = 0.2) -> DataFrame:
    return items.where(F.coalesce("ai_relevance", F.lit(0.7)) > least)


def stable_url(url: Column, unstable: tuple = L.UNSTABLE_URLS) -> Column:
    return (url != "") & ~X.contains_any(url, unstable)


def history_of(items: DataFrame, seen_at: Column) -> DataFrame:
    """(kind, value, seen_at) rows of items: normal address, title and cache title."""
    values = {"url": X.normal_url(F.col("url")), "title": F.col("title"), "norm_title": X.cache_title(F.col("title"))}
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in values.items()])
    return items.select(F.explode(pairs).alias("h"), seen_at.alias("seen_at")).select("h.*", "seen_at").where(F.coalesce("value", F.lit("")) != "")


def backfilled(history: DataFrame) -> DataFrame:
    """History with cache titles: one without any, as old ones are, gets them from its titles."""
    lacks = F.broadcast(history.agg((F.count_if(F.col("kind") == "norm_title") == 0).alias("_lacks")))  # one row
    made = history.where("kind = 'title'").crossJoin(lacks).where("_lacks").select(F.lit("norm_title").alias("kind"), X.cache_title(F.col("value")).alias("value"), "seen_at")
    return history.unionByName(made.where("value <> ''").groupBy("kind", "value").agg(F.max("seen_at").alias("seen_at")))


def flag_new(items: DataFrame, history: DataFrame) -> DataFrame:
    """`is_new`: no address, title or cache title of the item is in the history. Hashes of (kind, value), 128 bits each, meet the history's
    in one join; whole items meet only the keys of those found, once."""
    values = {"url": F.when(stable_url(F.col("url")), X.normal_url(F.col("url"))), "title": F.col("title"), "norm_title": X.cache_title(F.col("title"))}
    named = lambda kind, value: F.md5(F.concat_ws("\x1f", kind, value))
    hashes = F.array_compact(F.array(*[F.when(F.coalesce(v, F.lit("")) != "", named(F.lit(k), v)) for k, v in values.items()]))
    own = F.md5(F.to_json(F.struct(*[F.col(c) for c in ("ord", "url", "title")])))
    keyed = items.withColumn("_id", F.coalesce("item", own) if "item" in items.columns else own)
    asked = keyed.select("_id", F.explode(hashes).alias("_h"))
    known = history.where(F.col("kind").isin(*values) & F.col("value").isNotNull()).select(named(F.col("kind"), F.col("value")).alias("_h"))
    seen = asked.join(known, "_h", "left_semi").select("_id").distinct().withColumn("_seen", F.lit(True))
    return keyed.join(seen, "_id", "left").withColumn("is_new", F.col("_seen").isNull()).drop("_id", "_seen")


def new_only(items: DataFrame, history: DataFrame) -> DataFrame:
    return flag_new(items, history).where("is_new").drop("is_new")


def new_and_cached(items: DataFrame, history: DataFrame) -> DataFrame:
    return flag_new(items, history).groupBy("category").agg(F.count_if("is_new").alias("n_new"), F.count_if(~F.col("is_new")).alias("n_cached"))


def bounded_history(history: DataFrame, as_of: str | Column, most: int = 5000, share: float = 0.2, days: int = 7) -> DataFrame:
    """History within retention; a kind that has reached `most` values keeps its newest, a share less than `most`. Counts of
    values per second find the second in which the room ends; only that second is ranked, by value."""
    now = F.lit(as_of).cast("timestamp") if isinstance(as_of, str) else as_of
    fresh, room = history.where(F.col("seen_at") >= now - F.make_interval(days=F.lit(days))), int(most * (1 - share))
    per = fresh.groupBy("kind", "seen_at").agg(F.count("*").alias("n"))
    w = Window.partitionBy("kind").orderBy(F.desc("seen_at"))
    upto = per.withColumns({"upto": F.sum("n").over(w), "all": F.sum("n").over(Window.partitionBy("kind"))})
    left = F.when(F.col("all") < most, F.col("n")).otherwise(F.least("n", room - (F.col("upto") - F.col("n"))))
    kept = upto.select("kind", "seen_at", "n", left.alias("left")).where("left > 0")
    whole = fresh.join(kept.where("left = n"), ["kind", "seen_at"], "left_semi")
    rank = F.row_number().over(Window.partitionBy("kind", "seen_at").orderBy("value"))
    ended = fresh.join(kept.where("left < n").select("kind", "seen_at", "left"), ["kind", "seen_at"]).withColumn("_r", rank)
    return whole.unionByName(ended.where(F.col("_r") <= room).where(F.col("_r") <= F.col("left")).drop("_r", "left"))


def quota(items: DataFrame, quotas: dict[str, int], default: int = 25) -> DataFrame:
    """The first items of each category in arrival order."""
    limit = F.coalesce(F.try_element_at(F.from_json(F.lit(json.dumps(quotas)), "map<string,int>"), F.col("category")), F.lit(default))
    rank = F.row_number().over(Window.partitionBy("category").orderBy("ord"))
    # A constant bound lets Spark cut each task's rows before the shuffle.
    return items.withColumn("_r", rank).where(F.col("_r") <= max([default, *quotas.values()])).where(F.col("_r") <= limit).drop("_r")


def discussions(items: DataFrame, terms: tuple = L.DISCUSSION_TERMS) -> DataFrame:
    return about(items, terms, ("title",))


def launches(items: DataFrame, terms: tuple = L.LAUNCH_TERMS) -> DataFrame:
    return about(items, terms)


def company(feed_url: Column, domains: dict = L.COMPANY_DOMAINS) -> Column:
    out = None
    for domain, name in domains.items():
        out = F.when(F.contains(feed_url, F.lit(domain)), name) if out is None else out.when(F.contains(feed_url, F.lit(domain)), name)
    return out


def product_order(items: DataFrame, mode: str = "intended") -> DataFrame:
    """Company items first, newest first; `parity` puts them last, as the published ranking did."""
    has = F.col("company").isNotNull() & (F.col("company") != "")
    return items.orderBy(has.asc() if mode == "parity" else has.desc(), F.desc("published"), "ord")
