"""Aggregates: distributions, hotspots, daily trend, report, chart inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.operators.dedup import ranked_first


def distribution(items: DataFrame, column: str, default: str) -> DataFrame:
    return items.groupBy(F.coalesce(column, F.lit(default)).alias("key")).agg(F.count("*").alias("n"))


def distributions(items: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Several distributions in one pass: (dimension, key, n)."""
    pairs = F.array(*[F.struct(F.lit(c).alias("dimension"), F.coalesce(F.col(c).cast("string"), F.lit(d)).alias("key")) for c, d in columns.items()])
    return items.select(F.explode(pairs).alias("p")).groupBy("p.dimension", "p.key").agg(F.count("*").alias("n"))


#: What a state sums up beside counts, for averages.
MEASURES = ("confidence", "importance", "ai_relevance")


def daily_state(items: DataFrame, at: Column, columns: dict[str, str], arrays: tuple[str, ...] = ("tech_categories",)) -> DataFrame:
    """All distributions of items in one pass, as rows that add up: (day, dimension, key, n, first, and of each of `MEASURES` that the items
    have the sum and the count). `columns` are dimensions with their defaults, `arrays` count each element; the dimension `all`
    counts every item. States of parts of the items, a day's or a batch's, merge to the state of all."""
    one = lambda name, key: F.struct(F.lit(name).alias("dimension"), key.alias("key"))
    plain = F.array(one("all", F.lit("")), *[one(c, F.coalesce(F.col(c).cast("string"), F.lit(d))) for c, d in columns.items()])
    named = lambda c: lambda key: one(c, key)
    several = [F.transform(F.coalesce(c, F.array().cast("array<string>")), named(c)) for c in arrays]
    have = [m for m in MEASURES if m in items.columns]
    rows = items.select(F.date_format(at, "yyyy-MM-dd").alias("day"), "ord", *have, F.explode_outer(F.concat(plain, *several)).alias("d"))  # never empty; `explode` would filter by size first, and scan the texts for that
    sums = [x for m in have for x in (F.sum(m).alias(f"sum_{m}"), F.count(m).alias(f"n_{m}"))]
    return rows.groupBy("day", "d.dimension", "d.key").agg(F.count("*").alias("n"), F.min("ord").alias("first"), *sums)


def merged(*states: DataFrame) -> DataFrame:
    """One state of several."""
    both = states[0]
    for s in states[1:]:
        both = both.unionByName(s, allowMissingColumns=True)
    more = [c for c in both.columns if c not in ("day", "dimension", "key", "n", "first")]
    return both.groupBy("day", "dimension", "key").agg(F.sum("n").alias("n"), F.min("first").alias("first"), *[F.sum(c).alias(c) for c in more])


def of_state(state: DataFrame, dimension: str) -> DataFrame:
    """(key, n, first) of a dimension over all days."""
    return state.where(F.col("dimension") == dimension).groupBy("key").agg(F.sum("n").alias("n"), F.min("first").alias("first"))


def daily_of_state(state: DataFrame, last: int = 7) -> DataFrame:
    per = state.where("dimension = 'all' AND day IS NOT NULL").groupBy("day").agg(F.sum("n").alias("n"))
    return per.orderBy(F.desc("day")).limit(last).orderBy("day")


def averages_of_state(state: DataFrame) -> DataFrame:
    have = [m for m in MEASURES if f"sum_{m}" in state.columns]
    mean = lambda m: F.round(F.coalesce(F.sum(f"sum_{m}") / F.nullif(F.sum(f"n_{m}"), F.lit(0)), F.lit(0.0)), 4).alias(f"avg_{m}")
    return state.where("dimension = 'all'").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), *map(mean, have))


def shares(items: DataFrame, column: str, default: str) -> DataFrame:
    """Counts and percentages; the total is one row."""
    per = distribution(items, column, default)
    return per.crossJoin(F.broadcast(per.agg(F.sum("n").alias("_all")))).select("key", "n", F.round(F.col("n") * 100.0 / F.col("_all"), 2).alias("pct"))


def hotspots(items: DataFrame, n: int = 10) -> DataFrame:
    """The most frequent technical fields; ties go to the one seen first. `explode` would filter by size first, and scan the texts once more for that."""
    fields = F.transform("tech_categories", lambda x: F.struct(x.alias("key")))
    per = items.select("ord", F.explode_outer(fields).alias("field")).where(F.col("field").isNotNull()).groupBy("field.key").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    return per.orderBy(F.desc("n"), "first", "key").limit(n)


def daily(rows: DataFrame, at: Column, last: int = 7) -> DataFrame:
    """Counts of the last days that have any, oldest first."""
    per = rows.where(at.isNotNull()).groupBy(F.date_format(at, "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))
    return per.orderBy(F.desc("day")).limit(last).orderBy("day")


def raw_bucket(published: Column) -> Column:
    """The first ten characters of a date as it came."""
    return F.when(F.length(published) >= 10, F.left(published, F.lit(10)))


def type_counts(items: DataFrame, types: tuple[str, ...], default: str = "market") -> DataFrame:
    kind = F.coalesce("content_type", F.lit(default))
    return items.agg(F.count("*").alias("total"), *[F.count_if(kind == t).alias(f"n_{t}") for t in types])


def averages(items: DataFrame) -> DataFrame:
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 4).alias(f"avg_{c}")
    return items.agg(F.count("*").alias("n"), mean("confidence"), mean("importance"), mean("ai_relevance"), F.count_if(F.col("confidence") < 0.6).alias("n_unsure"), F.count_if(F.col("ai_relevance") < 0.5).alias("n_off_topic"), F.count_if(F.col("importance") >= 0.70).alias("n_important"))


def failures(rows: DataFrame, shown: int = 3) -> DataFrame:
    """Failed sources of each category, the first few with how many there are."""
    cut = rows.select("category", "ord", F.left("source", F.lit(80)).alias("source"), F.left("error", F.lit(100)).alias("error"))
    counts = cut.groupBy("category").agg(F.count("*").alias("failed"))
    return ranked_first(cut, ["category"], [F.col("ord")], shown).join(counts, "category").select("category", "rank", "source", "error", "failed")


def top_items(items: DataFrame, n: int = 3) -> DataFrame:
    """The report's items: by source and date, descending."""
    return items.orderBy(F.desc("source"), F.desc("published"), "ord").limit(n)


def run_statistics(items: DataFrame) -> DataFrame:
    """What a labelling run did, from the lineage tags."""
    by = F.coalesce("classified_by", F.lit(""))
    cached = F.coalesce("from_cache", F.lit(False))
    return items.agg(F.count("*").alias("total"), F.count_if(cached).alias("cache_hits"), F.count_if(by.startswith("llm") & ~cached).alias("llm_calls"), F.count_if(by.startswith("rule")).alias("fallbacks"), F.round(F.coalesce(F.avg(cached.cast("double")), F.lit(0.0)), 4).alias("hit_rate"))


def chart_label(content_type: Column) -> Column:
    return F.initcap(content_type)


def month_day(day: Column) -> Column:
    """`MM-dd` of a `yyyy-MM-dd` text."""
    return F.substring(day, 6, 5)


def chart_frames(items: DataFrame, at: Column, bars: int = 10, panel: int = 6) -> DataFrame:
    """(chart, rank, label, n) of every chart: fields as bars and in the dashboard, categories, regions and days."""
    from pyspark.sql import Window

    def ranked(chart: str, per: DataFrame, label: Column, order: list[Column], n: int | None) -> DataFrame:
        rows = per.orderBy(*order) if n is None else per.orderBy(*order).limit(n)
        return rows.select(F.lit(chart).alias("chart"), F.row_number().over(Window.orderBy(*order)).alias("rank"), label.alias("label"), "n")  # a few rows

    most = [F.desc("n"), F.col("key")]
    fields = hotspots(items, bars).select("key", "n", "first")
    frames = [
        ranked("fields", fields, F.col("key"), [F.desc("n"), F.col("first"), F.col("key")], bars),
        ranked("dashboard_fields", fields, F.col("key"), [F.desc("n"), F.col("first"), F.col("key")], panel),
        ranked("content", distribution(items, "content_type", "market"), chart_label(F.col("key")), most, None),
        ranked("regions", distribution(items, "region", "Global"), F.col("key"), most, None),
        ranked("days", daily(items, at), month_day(F.col("day")), [F.col("day")], None),
    ]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def report(items: DataFrame) -> str:
    """The text report; only top rows and distributions reach the driver."""
    total = items.count()
    lines = [f"Items: {total}", "", "Technical fields"]
    lines += [f"  {i}. {r.key}: {r.n}" for i, r in enumerate(hotspots(items, 5).collect(), 1)]
    lines += ["", "Content"] + [f"  {r.key}: {r.n} ({r.pct} %)" for r in shares(items, "content_type", "market").orderBy(F.desc("n"), "key").collect()]
    lines += ["", "Regions"] + [f"  {r.key}: {r.n}" for r in distribution(items, "region", "Global").orderBy(F.desc("n"), "key").collect()]
    lines += ["", "Items to read"] + [f"  {i}. {r.title} ({r.source})" for i, r in enumerate(top_items(items, 3).collect(), 1)]
    return "\n".join(lines) + "\n"
