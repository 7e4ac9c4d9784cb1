"""Exports, state tables and purging. State is replaced by writing a new version and pointing at it last."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.sources.shared import Scratch


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def export(items: DataFrame, path: str, run_ts: str, trends: DataFrame | None = None, reviewed: bool = False) -> None:
    """items/, metadata/ (one row) and trends/ under a partition of the run."""
    base = f"{path}/run_ts={run_ts}"
    items.write.mode("overwrite").json(f"{base}/items")
    items.agg(F.lit(run_ts).alias("timestamp"), F.count("*").alias("total_items"), F.lit(reviewed).alias("reviewed")).write.mode("overwrite").json(f"{base}/metadata")
    if trends is not None:
        trends.write.mode("overwrite").json(f"{base}/trends")


def text_report(spark: SparkSession, text: str, path: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the whole versions of a state, ascending: those whose writing has ended."""
    fs, root = _fs(spark, path)
    names = [x.getPath().getName() for x in fs.listStatus(root)] if fs.exists(root) else []
    numbers = sorted(int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit())
    return [n for n in numbers if fs.exists(_fs(spark, f"{path}/v={n}/_SUCCESS")[1])]


def replace_state(df: DataFrame, path: str) -> None:
    """Writes a new version beside the old ones. Readers take the newest whole one, so neither they nor a crash ever see half
    of a state; the version before it stays for those that still read it, older ones go."""
    spark = df.sparkSession
    known = _versions(spark, path)
    df.write.mode("overwrite").parquet(f"{path}/v={known[-1] + 1 if known else 0}")
    for old in known[:-1]:
        fs, gone = _fs(spark, f"{path}/v={old}")
        fs.delete(gone, True)


def merge_state(new: DataFrame, old: DataFrame, path: str, key: str) -> None:
    """A version with the rows of `new`, and of `old` those whose key `new` lacks. The new rows are a table first, so both uses see the same."""
    scratch = Scratch(new.sparkSession, "merge")
    fresh = scratch.table("new", new)
    replace_state(fresh.unionByName(old.join(fresh.select(key), key, "left_anti"), allowMissingColumns=True), path)
    scratch.drop()


def read_state(spark: SparkSession, path: str, schema: str, required: tuple[str, ...] = ()) -> DataFrame:
    """The newest whole version of a state, or an empty table if there is none, it can't be read or lacks a required column."""
    known = _versions(spark, path)
    if known:
        try:
            df = spark.read.parquet(f"{path}/v={known[-1]}")
            df.write.format("noop").mode("overwrite").save()  # damage shows in the pages, not in the footer alone
        except Exception as e:  # noqa: BLE001  a damaged state is an empty one, as a lost cache is
            logging.getLogger(__name__).warning("state %s can't be read: %s", path, e)
        else:
            if set(required) <= set(df.columns):
                return df
    return spark.createDataFrame([], schema)


def save_learned(feedback: DataFrame, path: str, before: int, every: int = 10) -> bool:
    """Keeps what reviews taught (importance.learned_authority of `feedback`) whenever the number of scores passes a multiple of
    `every`; `before` scores were known at the last call. True if it was kept."""
    from tidewell.operators.importance import learned_authority

    due = feedback.count() // every > before // every
    if due:
        replace_state(learned_authority(feedback), path)
    return due


def learning_report(summary: DataFrame, suggestions: DataFrame, patterns: DataFrame, path: str, run_ts: str) -> None:
    """One run's learning report: summary, suggestions and patterns, as JSON under a partition of the run."""
    base = f"{path}/run_ts={run_ts}"
    for name, df in (("summary", summary), ("suggestions", suggestions), ("patterns", patterns)):
        df.write.mode("overwrite").json(f"{base}/{name}")


def page(spark: SparkSession, html: str, path: str) -> None:
    """The HTML page under its run and as the latest one: two copies."""
    for where in (f"{path}/index", f"{path}/latest"):
        text_report(spark, html, where)


def purge(spark: SparkSession, *paths: str) -> int:
    """Deletes state folders; how many there were."""
    gone = 0
    for path in paths:
        fs, target = _fs(spark, path)
        gone += bool(fs.exists(target) and fs.delete(target, True))
    return gone
