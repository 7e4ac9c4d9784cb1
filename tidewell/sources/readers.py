"""Landed API answers and feeds as item rows, and snapshots. Everything is a lazy Spark scan."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import text as X
from tidewell.functions.html import plain_text
from tidewell.schema import conform


def rss(spark: SparkSession, path: str, category: str, source: str | None = None) -> DataFrame:
    """Items of RSS files."""
    schema = "title string, description string, link string, pubDate string, author string"
    df = spark.read.format("xml").option("rowTag", "item").schema(schema).load(path)
    out = df.select(X.collapse(F.col("title")).alias("title"), plain_text(F.coalesce("description", F.lit(""))).alias("summary"), F.trim("link").alias("url"), F.col("pubDate").alias("published"), F.coalesce("author", F.lit("")).alias("author"), F.lit(category).alias("category"), F.left(F.lit(source or category), F.lit(50)).alias("source"))
    return conform(out.withColumns({"published_ts": X.parsed_date(F.col("published")), "ord": F.monotonically_increasing_id()}))


def atom(spark: SparkSession, path: str, category: str = "research", source: str = "arXiv") -> DataFrame:
    """Items of Atom files, as preprint servers answer."""
    schema = "title string, summary string, id string, published string, author array<struct<name:string>>"
    df = spark.read.format("xml").option("rowTag", "entry").schema(schema).load(path)
    out = df.select(X.collapse(F.col("title")).alias("title"), plain_text(F.col("summary")).alias("summary"), F.col("id").alias("url"), F.left("published", F.lit(10)).alias("published"), F.col("author.name").alias("authors"), F.lit(category).alias("category"), F.lit(source).alias("source"))
    return conform(out.withColumns({"published_ts": X.parsed_date(F.col("published")), "ord": F.monotonically_increasing_id()}))


def repositories(spark: SparkSession, path: str) -> DataFrame:
    """Items of a repository search answer: one object with `items`."""
    schema = "items array<struct<full_name:string,description:string,html_url:string,stargazers_count:bigint,language:string,created_at:string,updated_at:string>>"
    r = spark.read.schema(schema).json(path, multiLine=True).select(F.inline("items"))
    return conform(r.select(F.col("full_name").alias("title"), plain_text(F.coalesce("description", F.lit(""))).alias("summary"), F.col("html_url").alias("url"), F.col("stargazers_count").alias("stars"), F.coalesce("language", F.lit("Unknown")).alias("language"), F.left("created_at", F.lit(10)).alias("published"), F.left("updated_at", F.lit(10)).alias("updated"), X.parsed_date(F.left("updated_at", F.lit(10))).alias("published_ts"), F.lit("GitHub").alias("source"), F.lit("developer").alias("category"), F.monotonically_increasing_id().alias("ord"))).orderBy(F.desc("stars"))


def models(spark: SparkSession, path: str, base: str = "https://huggingface.co/") -> DataFrame:
    """Items of a model listing: an array of objects."""
    r = spark.read.schema("modelId string, downloads bigint, likes bigint, lastModified string, pipeline_tag string").json(path, multiLine=True)
    return conform(r.select(F.col("modelId").alias("title"), F.concat(F.lit("Model for "), F.coalesce("pipeline_tag", F.lit("various tasks"))).alias("summary"), F.concat(F.lit(base), "modelId").alias("url"), "downloads", "likes", F.left("lastModified", F.lit(10)).alias("published"), X.parsed_date(F.left("lastModified", F.lit(10))).alias("published_ts"), F.lit("Hugging Face").alias("source"), F.lit("developer").alias("category"), F.monotonically_increasing_id().alias("ord")))


def stories(spark: SparkSession, path: str) -> DataFrame:
    """Items of discussion stories, one JSON object a line."""
    r = spark.read.schema("id bigint, title string, url string, score bigint, by string, time bigint, descendants bigint").json(path)
    at = F.timestamp_seconds("time")
    return conform(r.select("title", F.coalesce("url", F.concat(F.lit("https://news.ycombinator.com/item?id="), "id")).alias("url"), "score", F.col("by").alias("author"), F.col("descendants").alias("comments"), F.date_format(at, "yyyy-MM-dd").alias("published"), at.alias("published_ts"), F.lit("Hacker News").alias("source"), F.lit("community").alias("category"), F.col("id").alias("ord")))


def fetched(urls: DataFrame, fetch: Callable[[str], tuple[int, str]], retries: int = 2, delay: float = 1.0, sleep: Callable[[float], None] | None = None, per_host: int = 3) -> DataFrame:
    """(url, status, body, error) of each address. Hosts are dealt to partitions, so each is asked in turn; 429 waits longer
    each time, time-outs a little longer, other answers and errors end the attempts. A failure is a row, never the end of the job."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        wait = sleep or time.sleep
        for pdf in batches:
            rows = []
            for url in pdf.url:
                status, body, error = None, None, None
                for attempt in range(retries + 1):
                    try:
                        status, body = fetch(url)
                        error = None if status == 200 else f"HTTP {status}"
                    except TimeoutError:
                        error = "timeout"
                        wait(delay * (attempt + 1))
                        continue
                    except Exception as e:  # noqa: BLE001  a client may raise anything
                        error = f"{type(e).__name__}: {e}"[:100]
                        break
                    if status != 429:
                        break
                    wait(delay * 2**attempt)
                rows.append((url, status, body if status == 200 else None, error))
            yield pd.DataFrame(rows, columns=["url", "status", "body", "error"]).astype({"status": "Int64"})

    lane = F.pmod(F.xxhash64("url"), F.lit(per_host))
    return urls.select("url").repartition(F.try_parse_url("url", F.lit("HOST")), lane).mapInPandas(run, "url string, status int, body string, error string")


def exported(spark: SparkSession, path: str, pattern: str = "*.json", mode: str = "intended") -> DataFrame:
    """The rows of the latest snapshot under `path`: by time of change, or (`parity`) by name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "modificationTime")
    order = [F.desc("path")] if mode == "parity" else [F.desc("modificationTime"), F.desc("path")]
    latest = files.orderBy(*order).limit(1).collect()
    if not latest:
        raise FileNotFoundError(f"no snapshot in {path}")
    return spark.read.json(latest[0].path, multiLine=True).select(F.inline("data"))
