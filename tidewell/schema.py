"""The item table: one row per collected text, nullable fields, an explicit order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ITEM = (
    "ord bigint, category string, category_rank int, title string, summary string, description string, url string, source string, "
    "published string, published_ts timestamp, updated string, author string, author_title string, authors array<string>, categories array<string>, "
    "company string, language string, stars bigint, downloads bigint, score bigint, points bigint, likes bigint, comments bigint, region string, item string"
)
FIELDS = {x.split(" ")[0]: x.split(" ")[1] for x in ITEM.split(", ")}


#: What makes an item: readers count `ord` from 0 for every source, so it tells none apart by itself.
IDENTITY = ("category", "source", "ord", "url", "title")


def conform(df: DataFrame) -> DataFrame:
    """All item columns with their types, missing ones null, and each item's key; other columns stay. A key that an item
    has stays too, so it outlives a new order, category or title."""
    own = set(df.columns)
    made = [F.col(c).cast(t).alias(c) if c in own else F.lit(None).cast(t).alias(c) for c, t in FIELDS.items()]
    out = df.select(*made, *[c for c in df.columns if c not in FIELDS])
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in IDENTITY]
    return out.withColumn("item", F.coalesce("item", F.md5(F.concat_ws("\x1f", *parts))))


def keys(*tables: DataFrame) -> str:
    """The column that tells the tables' items apart: `item`, or `ord` where one of them has no keys."""
    return "item" if all("item" in t.columns for t in tables) else "ord"
