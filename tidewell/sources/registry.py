"""The feeds as a table, and the rows that stand in for a source that fails."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.lexicons import FEEDS
from tidewell.operators.filters import company


def feeds(spark: SparkSession) -> DataFrame:
    """(feed_group, url, author, title, type, company)."""
    rows = [(g, f, None, None, None) if isinstance(f, str) else (g, f["url"], f.get("author"), f.get("title"), f.get("type")) for g, own in FEEDS.items() for f in own]
    return spark.createDataFrame(rows, "feed_group string, url string, author string, title string, type string").withColumn("company", company(F.col("url")))


def per_feed(quota: int, n_feeds: int) -> tuple[int, int]:
    """(feeds to read, items of each) for a news quota."""
    used = min(n_feeds, max(6, quota // 3))
    return used, max(2, quota // max(1, n_feeds))


def developer_split(quota: int, n_feeds: int) -> tuple[int, int, int]:
    """(repositories, models, items of each developer feed) for a developer quota."""
    one = min(5, quota // 3)
    return one, one, max(2, (quota - 2 * one) // max(1, n_feeds))


def with_backup(rows: DataFrame, backup: DataFrame, least: int = 5) -> DataFrame:
    """`rows`, and the backup rows too if there are fewer than `least`."""
    few = F.broadcast(rows.limit(least).agg((F.count("*") < least).alias("_few")))
    return rows.unionByName(backup.crossJoin(few).where("_few").drop("_few"), allowMissingColumns=True)
