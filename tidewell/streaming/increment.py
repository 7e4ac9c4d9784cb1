"""The collection loop as a stream: duplicates within the retention go by watermark, then history and labels by batch."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewell.functions import text as X
from tidewell.operators import filters
from tidewell.schema import ITEM, conform


def stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Items that land as JSON lines."""
    return conform(spark.readStream.schema(ITEM).option("maxFilesPerTrigger", files_per_batch).json(path))


def distinct_items(items: DataFrame, retention: str = "7 days") -> DataFrame:
    """One item per fingerprint within the retention; state is dropped behind the watermark."""
    keyed = filters.valid(items).withColumn("fp", X.fingerprint(F.col("url"), F.col("title")))
    return keyed.withWatermark("published_ts", retention).dropDuplicatesWithinWatermark(["fp"]).drop("fp")


def daily_counts(items: DataFrame, late: str = "7 days") -> DataFrame:
    return items.withWatermark("published_ts", late).groupBy(F.window("published_ts", "1 day")).agg(F.count("*").alias("n")).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "n")


def run(items: DataFrame, history: str, out: str, checkpoint: str, label: Callable[[DataFrame], DataFrame], available_now: bool = True, most: int = 5000, days: int = 7) -> StreamingQuery:
    """Each batch: what history has not seen is labelled and written, and history grows by it. Folders carry the batch's
    number, so a batch that is run again replaces its own output. A history folder holds all that is remembered, within
    `days` and `most` values of a kind, so a batch reads one folder and older ones go."""

    def batch(df: DataFrame, n: int) -> None:
        spark = df.sparkSession
        known = _batches(spark, history, n)
        seen = spark.read.parquet(f"{history}/batch={known[-1]}") if known else spark.createDataFrame([], "kind string, value string, seen_at timestamp")
        fresh = filters.new_only(df, seen).persist()
        label(fresh).write.mode("overwrite").parquet(f"{out}/batch={n}")
        now = F.lit(datetime.now(timezone.utc))  # one moment for the whole batch
        grown = seen.unionByName(filters.history_of(fresh, now)).groupBy("kind", "value").agg(F.max("seen_at").alias("seen_at"))
        filters.bounded_history(grown, now, most, days=days).write.mode("overwrite").parquet(f"{history}/batch={n}")
        fresh.unpersist()
        _delete(spark, [f"{history}/batch={x}" for x in known[:-1]])

    writer = items.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _folder(spark: SparkSession, path: str):
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), root


def _batches(spark: SparkSession, path: str, before: int) -> list[int]:
    """Numbers of the whole history folders before a batch, ascending."""
    fs, root = _folder(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    numbers = sorted(int(n.split("=")[1]) for n in names if n.startswith("batch="))
    return [n for n in numbers if n < before and fs.exists(_folder(spark, f"{path}/batch={n}/_SUCCESS")[1])]


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        fs, gone = _folder(spark, path)
        fs.delete(gone, True)
