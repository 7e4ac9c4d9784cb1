"""Items from the test tables, and the same derivation as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.schema import conform

AS_OF = "2024-01-31 00:00:00"
CATEGORIES = ("research", "developer", "product", "news", "leader", "community")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as an item: its first sentence is the title, its whole text the summary."""
    d = table(spark, sf_dir, "documents")
    rank = F.pmod("doc_id", F.lit(6)).cast("int")
    at = F.timestamp_add("DAY", F.pmod("doc_id", F.lit(30)), F.lit("2024-01-01").cast("timestamp"))
    return conform(d.select(
        F.col("doc_id").alias("ord"), F.element_at(F.array(*map(F.lit, CATEGORIES)), rank + 1).alias("category"), rank.alias("category_rank"),
        F.regexp_extract("text", r"^[^.\n]*", 0).alias("title"), F.col("text").alias("summary"),
        F.concat(F.lit("https://"), "source", F.lit(".example.com/"), "lang", F.lit("/"), F.pmod("n_chars", F.lit(500)).cast("string")).alias("url"),
        "source", F.date_format(at, "yyyy-MM-dd").alias("published"), at.alias("published_ts"),
        (F.col("n_chars") * 13).alias("stars"), F.pmod("n_chars", F.lit(700)).alias("comments"), F.when(F.pmod("doc_id", F.lit(2)) == 0, "OpenAI").alias("company"),
    ))


ITEMS = """items AS (
    SELECT doc_id AS ord, ['research', 'developer', 'product', 'news', 'leader', 'community'][CAST(doc_id % 6 AS INT) + 1] AS category, CAST(doc_id % 6 AS INT) AS category_rank,
        regexp_extract(text, '^[^.\\n]*', 0) AS title, text AS summary,
        'https://' || source || '.example.com/' || lang || '/' || CAST(n_chars % 500 AS VARCHAR) AS url, source,
        strftime(CAST('2024-01-01' AS DATE) + CAST(doc_id % 30 AS INT), '%Y-%m-%d') AS published,
        CAST(CAST('2024-01-01' AS DATE) + CAST(doc_id % 30 AS INT) AS TIMESTAMP) AS published_ts,
        n_chars * 13 AS stars, n_chars % 700 AS comments, CASE WHEN doc_id % 2 = 0 THEN 'OpenAI' END AS company
    FROM documents
)"""


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the first half of the month brought."""
    from tidewell.operators import filters

    old = items(spark, sf_dir).where("published < '2024-01-16'")
    return filters.history_of(old, F.col("published_ts"))


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label table as review decisions."""
    d = table(spark, sf_dir, "labels")
    action = F.when(F.col("toxic") == 1, "spam").when(F.col("quality") == 0, "category").otherwise("confirm")
    return d.select(F.col("doc_id").alias("ord"), action.alias("action"), F.when(action == "category", F.element_at(F.array(*map(F.lit, ("market", "product", "leader"))), (F.pmod("doc_id", F.lit(3)) + 1).cast("int"))).alias("value"))


DECISIONS = """decisions AS (
    SELECT doc_id AS ord, CASE WHEN toxic = 1 THEN 'spam' WHEN quality = 0 THEN 'category' ELSE 'confirm' END AS action,
        CASE WHEN toxic = 1 THEN NULL WHEN quality = 0 THEN ['market', 'product', 'leader'][CAST(doc_id % 3 AS INT) + 1] END AS value
    FROM labels
)"""
