"""Sources made of others: a feed behind its history, community, product releases, leaders' quotes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell import lexicons as L
from tidewell.functions import text as X
from tidewell.operators import dedup, filters
from tidewell.schema import conform
from tidewell.sources.registry import with_backup

#: Items of one list come before those of the next: `ord` within a list stays below this.
LIST = 1 << 40


def chained(*lists: DataFrame) -> DataFrame:
    """The lists one after another, with `ord` telling their order."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [x.withColumn("ord", F.col("ord") + F.lit(i * LIST)) for i, x in enumerate(lists)])


def unseen(entries: DataFrame, history: DataFrame, n: int, feed: str = "feed") -> DataFrame:
    """Of the first 2 n entries of each feed the first n whose address history does not know; without an address they go.
    The ranks are bounded, so tasks cut their rows before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(feed).orderBy("ord"))
    seen = history.where("kind = 'url'").select(F.col("value").alias("_url")).distinct()
    early = entries.withColumn("_r", rank).where(F.col("_r") <= 2 * n).withColumn("_url", X.normal_url(F.col("url"))).where(F.coalesce("_url", F.lit("")) != "")
    return early.join(seen, "_url", "left_anti").withColumn("_r", rank).where(F.col("_r") <= n).drop("_r", "_url")


def feed_items(entries: DataFrame, history: DataFrame, as_of: str, n: int, days: int = 7) -> DataFrame:
    """What a collection takes of its feeds: unseen, recent and valid items."""
    return filters.valid(filters.recent(unseen(entries, history, n), as_of, days))


def top_stories(stories: DataFrame, history: DataFrame, as_of: str, n: int = 10, first: int = 50, days: int = 7) -> DataFrame:
    """Of the first stories in order those on the topic that are new and recent, `n` at most."""
    seen = history.where("kind = 'url'").select(F.col("value").alias("_url")).distinct()
    topical = filters.recent(filters.discussions(stories.orderBy("ord").limit(first)), as_of, days)
    return topical.withColumn("_url", X.normal_url(F.col("url"))).join(seen, "_url", "left_anti").drop("_url").orderBy("ord").limit(n)


def preprints(entries: DataFrame, as_of: str, n: int = 10, days: int = 7) -> DataFrame:
    """The newest `n` preprints, of them the recent ones; a failed scan (no entries at all) gives the backup rows."""
    spark = entries.sparkSession
    newest = entries.orderBy(F.desc("published_ts"), "ord").limit(n)
    spare = backup(spark, "research", as_of).join(F.broadcast(newest.limit(1).agg(F.count("*").alias("_n"))), F.col("_n") == 0).drop("_n")  # one row
    return filters.recent(newest, as_of, days).unionByName(spare, allowMissingColumns=True)


def trending(repositories: DataFrame, history: DataFrame, as_of: str, n: int = 10, days: int = 7) -> DataFrame:
    """Of the first n + 5 repositories by stars (as many as a search asks for, 15 at most) those that history lacks and that are recent, `n` at most."""
    seen = history.where("kind = 'url'").select(F.col("value").alias("_url")).distinct()
    asked = repositories.orderBy(F.desc("stars"), "ord").limit(min(n + 5, 15)).withColumn("_url", X.normal_url(F.col("url"))).where("_url <> ''")
    fresh = filters.recent(asked.join(seen, "_url", "left_anti").drop("_url"), as_of, days)
    return fresh.withColumn("published", F.col("updated")).orderBy(F.desc("stars"), "ord").limit(n)


def community(stories: DataFrame, feeds: DataFrame, n: int = 15) -> DataFrame:
    """Stories and community feeds without duplicates, newest first."""
    both = chained(stories, feeds).withColumn("category", F.lit("community"))
    return dedup.semantic_first(both, [F.desc(F.coalesce("published", F.lit(""))), F.col("ord")], n)


def product_releases(entries: DataFrame, n: int = 10, mode: str = "intended") -> DataFrame:
    """Items of product feeds (with `feed_url`) that announce something, with their company, in product order."""
    own = F.coalesce(F.nullif(F.col("company"), F.lit("")), filters.company(F.col("feed_url")))
    return filters.product_order(filters.launches(entries).withColumn("company", own), mode).limit(n)


def leader_quotes(found: DataFrame, blogs: DataFrame, as_of: str, n: int = 15, leaders: dict = L.LEADERS) -> DataFrame:
    """Items found for leaders (`leader` names whom), their blogs, and backup rows if both are few; without duplicates."""
    titles = F.create_map(*[F.lit(x) for pair in leaders.items() for x in pair])
    said = found.withColumns({"author": F.col("leader"), "author_title": F.try_element_at(titles, F.col("leader"))}).drop("leader")
    quotes = chained(said, blogs).withColumn("category", F.lit("leader"))
    spare = backup(found.sparkSession, "leader", as_of).withColumn("ord", F.col("ord") + F.lit(2 * LIST))
    return dedup.semantic_first(with_backup(quotes, spare), [F.col("ord")], n)


def backup(spark: SparkSession, kind: str, as_of: str, rows: dict = L.BACKUP) -> DataFrame:
    """The rows that stand in for a source, dated by the run."""
    own = [{"ord": i, "category": kind, "published": as_of[:10], "updated": as_of[:10], **r} for i, r in enumerate(rows[kind])]
    names = sorted({k for r in own for k in r})
    kinds = {"ord": "long", "stars": "long", "downloads": "long", "authors": "array<string>", "categories": "array<string>"}
    schema = ", ".join(f"{n} {kinds.get(n, 'string')}" for n in names)
    return conform(spark.createDataFrame([tuple(r.get(n) for n in names) for r in own], schema).withColumn("published_ts", F.col("published").cast("timestamp")))
