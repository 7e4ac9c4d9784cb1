"""Quotation linking for message tables, with DataFrame functions only.

A line's quote level is the number of `>` before its text. Runs of lines with one level are passages. Own
(unquoted) text gives keys: the hash of the whole and of each line, normalised (lower case, white space
collapsed); quoted passages give the hash of the whole run and of each line. A whole run is linked to the first
message of the same conversation with its key, if that is an earlier turn. Else each of the passage's different
stretches of 1, 2, 4, .. `WIDTHS` following lines (blank ones left out) names the first message with it, if that is an
earlier turn; the message named by the longest stretch is linked, then that named by the most of that length, then by
the one that comes first in the passage, then the first. Of a message's links the one with the lowest level wins, then
whole runs, then the longest stretch, then the most, then the latest turn: that message is what it replies to.

Threads are found by pointer jumping over the links (a logarithm of the longest chain in rounds, none if nothing is
quoted): `thread` is the first turn of the chain and `depth` the number of replies before. Sorted by conv_id, thread,
turn, every message comes after the one that it replies to. `message` is the own text in the chat format, so a
conversation is its messages in that order.

A line such as "On Monday Ann wrote:" directly before a quoted line belongs to the quote: it is no own text. `position` counts a
conversation's messages in the order of thread and turn from 1; messages of equal turns share the lowest place. It comes from a range sort,
the sizes of its parts and a running sum within each, so one conversation of any size is spread over many tasks.

Hot keys: originals are reduced to one row per conversation and key before every join, so a quoted run or stretch
meets one row at most, however many messages have the line; the quoting side of a hot key can be split by adaptive
execution. Nothing is collected per conversation.

Cases: a null or empty text is an empty message; null conv_id or turn are kept and never linked; repeated rows stay
and get equal answers (with differing quotes on one turn, the earliest original counts); a message that only
quotes has empty own text; an empty table gives no rows; extra columns are ignored; long texts count whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

QUOTED = r"^((?:[ \t]*>)+)[ \t]?"
WIDTHS = (1, 2, 4, 8, 16)
ATTRIBUTION = r"(?i)^[^\n]{0,200}(?:wrote|schrieb|a écrit|escribió)[ \t]*:[ \t]*$"


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def parsed(text: Column) -> Column:
    """array<struct<level, text>> of a text's lines."""
    return F.transform(F.split(text, "\n", -1), lambda x: F.struct(F.length(F.regexp_replace(F.regexp_extract(x, QUOTED, 1), "[^>]", "")).alias("level"), F.regexp_replace(x, QUOTED, "").alias("text")))


def passages(lines: Column) -> Column:
    """array<struct<level, text, lines>> of the quoted runs: starts where the level changes, text by slices."""
    n = F.size(lines)
    level = lambda i: F.element_at(lines, i)["level"]
    starts = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (level(i) != level(F.greatest(i - 1, F.lit(1)))))
    ends = F.concat(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), F.array((n + 1).cast("int")))
    runs = F.transform(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda r: F.slice(lines, r["s"], r["e"] - r["s"]))
    runs = F.filter(runs, lambda r: r[0]["level"] > 0)
    return F.transform(runs, lambda r: F.struct(r[0]["level"].alias("level"), F.array_join(r["text"], "\n").alias("text"), r["text"].alias("lines")))


def keys(texts: Column) -> Column:
    """Hashes of the normalised texts that are not empty."""
    return F.transform(F.filter(F.transform(texts, normalised), lambda t: t != ""), F.md5)


def stretches(lines: Column) -> Column:
    """array<struct<width, pos, key>> of the runs of following lines, for each of WIDTHS."""
    widths = F.filter(F.array(*map(F.lit, WIDTHS)), lambda w: w <= F.size(lines))
    at = lambda w: F.transform(F.sequence(F.lit(1), F.size(lines) - w + 1), lambda i: F.struct(w.alias("width"), i.alias("pos"), F.md5(F.array_join(F.slice(lines, i, w), "")).alias("key")))
    return F.flatten(F.transform(widths, at))


def link(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per message: conv_id, turn, role, n_quotes, deepest, reply_to, thread, depth, position, message, own (its text without quotes)."""
    scratch = Scratch(messages.sparkSession, "quotes")
    rows = messages.select(F.col(conversation).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    quoting = F.col("text").rlike(f"(?m){QUOTED}")
    # Tables, as lines are looked up line by line: a column that is merely named would be parsed anew for each of them.
    rows = scratch.table("parsed", rows.select("conv_id", "turn", "role", F.when(~quoting, F.col("text")).alias("text"), F.when(quoting, parsed(F.col("text"))).alias("lines")))
    quoting = F.col("lines").isNotNull()
    attributed = lambda x, i: x["text"].rlike(ATTRIBUTION) & F.coalesce(F.get("lines", i + 1)["level"] > 0, F.lit(False))
    own = F.when(quoting, F.array_join(F.filter("lines", lambda x, i: (x["level"] == 0) & ~attributed(x, i))["text"], "\n")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", "role", own.alias("own"), F.when(quoting, passages(F.col("lines"))).otherwise(F.expr("array()").cast("array<struct<level:int,text:string,lines:array<string>>>")).alias("quotes"))
    rows = scratch.table("rows", rows)
    scratch.drop("parsed")
    placed = rows.where("conv_id is not null and turn is not null")
    quote = placed.where(F.size("quotes") > 0).select("conv_id", "turn", F.explode("quotes").alias("q"))
    quote = quote.select("conv_id", "turn", F.col("q.level").alias("level"), F.try_element_at(keys(F.array("q.text")), F.lit(1)).alias("key"), keys(F.col("q.lines")).alias("lines")).where("key is not null")
    quote = scratch.table("quotes", quote.distinct())
    said = placed.join(quote.select("conv_id").distinct(), "conv_id", "left_semi").select("conv_id", F.col("turn").alias("at"), F.explode(F.array_distinct(keys(F.concat(F.array("own"), F.split("own", "\n", -1))))).alias("key"))
    origin = said.groupBy("conv_id", "key").agg(F.min("at").alias("at"))
    whole = scratch.table("whole", quote.join(origin, ["conv_id", "key"]).where("at < turn").select("conv_id", "turn", "level", "key", "at"))
    passage = ["conv_id", "turn", "level", "passage"]
    rest = scratch.table("rest", quote.join(whole, ["conv_id", "turn", "level", "key"], "left_anti").withColumnRenamed("key", "passage"))
    parts = rest.select(*passage, F.explode(stretches(F.col("lines"))).alias("s")).groupBy(*passage, "s.width", "s.key").agg(F.min("s.pos").alias("pos"))
    held = placed.join(rest.select("conv_id").distinct(), "conv_id", "left_semi").select("conv_id", "turn", F.explode(stretches(keys(F.split("own", "\n", -1)))).alias("s"))
    held = held.groupBy("conv_id", "s.key").agg(F.min("turn").alias("at"))
    met = parts.join(held, ["conv_id", "key"]).where("at < turn").groupBy(*passage, "width", "at").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    most = met.groupBy(*passage).agg(F.max(F.struct("width", "n", (-F.col("pos")).alias("early"), (-F.col("at")).alias("first"))).alias("x"))
    none, back = F.lit(0).cast("long"), (-F.col("at")).alias("late")
    linked = whole.select("conv_id", "turn", "level", F.lit(0).alias("rank"), F.lit(0).alias("narrow"), none.alias("fewer"), back)
    linked = linked.unionByName(most.select("conv_id", "turn", "level", F.lit(1).alias("rank"), (-F.col("x.width")).alias("narrow"), (-F.col("x.n")).alias("fewer"), F.col("x.first").alias("late")))
    best = linked.groupBy("conv_id", "turn").agg(F.min(F.struct("level", "rank", "narrow", "fewer", "late")).alias("x"))
    links = scratch.table("links", best.select("conv_id", "turn", (-F.col("x.late")).alias("reply_to")))
    chains = _threads(links, scratch)
    out = rows.join(links.join(chains, ["conv_id", "turn"]), ["conv_id", "turn"], "left").withColumn("thread", F.coalesce("thread", "turn"))
    out = scratch.table("threaded", out)
    out = out.join(_positions(out, scratch), ["conv_id", "turn"], "left")
    message = F.concat(F.lit("<|"), F.coalesce("role", F.lit("user")), F.lit("|>\n"), F.col("own"), F.lit("<|end|>\n"))
    return out.select(
        "conv_id", "turn", "role", F.size("quotes").cast("long").alias("n_quotes"),
        F.coalesce(F.array_max(F.transform("quotes", lambda q: q["level"])), F.lit(0)).cast("long").alias("deepest"),
        "reply_to", "thread", F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), "position", message.alias("message"), "own",
    )


def _positions(messages: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, turn, position): how many messages of the conversation come before, by thread and turn, and one."""
    turns = messages.where("conv_id is not null and turn is not null").groupBy("conv_id", "thread", "turn").agg(F.count("*").alias("n"))
    parts = scratch.table("places", turns.repartitionByRange("conv_id", "thread", "turn").withColumn("part", F.spark_partition_id()))
    upto = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    sizes = parts.groupBy("conv_id", "part").agg(F.sum("n").alias("size"))
    starts = sizes.select("conv_id", "part", F.coalesce(F.sum("size").over(upto("conv_id").orderBy("part")), F.lit(0)).alias("start"))  # a row for each part
    before = F.coalesce(F.sum("n").over(upto("conv_id", "part").orderBy("thread", "turn")), F.lit(0))
    return parts.withColumn("before", before).join(starts, ["conv_id", "part"]).select("conv_id", "turn", (F.col("start") + F.col("before") + 1).alias("position"))


def _threads(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, turn, thread, depth): each round doubles how far back a message sees."""
    seen = links.select("conv_id", "turn", F.col("reply_to").alias("thread"), F.lit(1).cast("long").alias("depth"))
    step = 0
    while True:
        back = seen.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("further"), F.col("depth").alias("more"))
        joined = seen.join(back, ["conv_id", "thread"], "left")
        if not joined.where("further is not null").limit(1).count():
            return seen
        step += 1
        seen = scratch.table(f"threads-{step}", joined.select("conv_id", "turn", F.coalesce("further", "thread").alias("thread"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")))
