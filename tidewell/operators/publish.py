"""Ranked, sectioned publication."""

from __future__ import annotations

import html

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import text as X
from tidewell.lexicons import NAME_PLACES, PERSONS
from tidewell.operators.dedup import ranked_first
from tidewell.operators.filters import publishable

SECTIONS = ("leader", "product", "market", "research", "developer", "community")


def section(content_type: Column) -> Column:
    return F.when(content_type.isin(*SECTIONS), content_type).otherwise("market")


def web_order(mode: str = "intended") -> list[Column]:
    """Most important first, then newest; `parity`: least important first, as the published order was."""
    return [F.col("importance").asc() if mode == "parity" else F.desc("importance"), F.desc("_date"), F.col("ord")]


def dated(items: DataFrame) -> DataFrame:
    return items.withColumn("_date", F.coalesce("published_ts", F.lit("0001-01-01").cast("timestamp")))


def sections(items: DataFrame, visible: int = 6, mode: str = "intended") -> DataFrame:
    """The visible items of each section in order."""
    placed = dated(publishable(items)).withColumn("section", section(F.col("content_type")))
    top = ranked_first(placed, ["section"], web_order(mode), visible).drop("_date")
    return top.withColumn("section_rank", F.array_position(F.array(*map(F.lit, SECTIONS)), F.col("section")))


def table_rows(items: DataFrame, n: int = 200, mode: str = "intended") -> DataFrame:
    return dated(publishable(items)).orderBy(*web_order(mode)).limit(n).drop("_date")


def card(summary: Column) -> Column:
    """The summary as shown: escaped, then cut if the raw text was long."""
    safe = X.escaped(F.coalesce(summary, F.lit("")))
    return F.when(F.length(summary) > 150, F.concat(F.left(safe, F.lit(150)), F.lit("..."))).otherwise(safe)


def tags(fields: Column, n: int = 2) -> Column:
    """The technical fields that a card shows."""
    return F.slice(F.coalesce(fields, F.array().cast("array<string>")), 1, n)


def person(author: Column, title: Column, summary: Column, source: Column, known: tuple = PERSONS) -> Column:
    """Whose statement an item is: the author, a known name, a name by its place, or the source."""
    text = F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(summary, F.lit("")))
    names = F.filter(X.strings(known), lambda n: F.contains(F.lower(text), F.lower(n)))
    return F.coalesce(
        F.when((author != "") & (author != "Unknown"), author),
        F.try_element_at(names, F.lit(1)),
        *[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in NAME_PLACES],
        F.when(F.contains(source, F.lit("News about")), F.replace(source, F.lit("News about "), F.lit(""))),
        F.nullif(source, F.lit("")),
        F.lit("Industry Voice"),
    )


def indicators(items: DataFrame) -> DataFrame:
    kind = F.coalesce("content_type", F.lit("market"))
    return items.agg(*[F.count_if(kind == t).alias(f"n_{t}") for t in ("product", "market", "community", "research")])


def page(items: DataFrame, title: str = "Digest") -> str:
    """The HTML page; the driver gets six rows a section and 200 table rows at most."""
    out = [f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>"]
    rows = sections(items).select("section", "rank", "title", "url", card(F.col("summary")).alias("card"), "section_rank").orderBy("section_rank", "rank").collect()
    for name in SECTIONS:
        own = [r for r in rows if r.section == name]
        if own:
            out.append(f"<h2>{name.title()}</h2>" + "".join(f"<article><a href='{html.escape(r.url or '')}'>{html.escape(r.title or '')}</a><p>{r.card}</p></article>" for r in own))
    body = "".join(f"<tr><td>{html.escape(r.title or '')}</td><td>{html.escape(r.source or '')}</td><td>{r.importance}</td></tr>" for r in table_rows(items).select("title", "source", "importance").collect())
    return "\n".join([*out, f"<table>{body}</table></body></html>"])
