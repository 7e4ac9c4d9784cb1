"""Labels by a language model: cache, prompts, replies, breaker, rule fallback. The client is a plug."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell import lexicons as L
from tidewell.functions import text as X
from tidewell.operators.order import numbered
from tidewell.schema import keys
from tidewell.sources.shared import Scratch

TYPES = ("research", "product", "market", "developer", "leader", "community")
REPLY = "struct<content_type:string,type:string,confidence:double,ai_relevance:double,tech_fields:array<string>,fields:array<string>,is_verified:boolean,reasoning:string,reason:string,id:int>"


def cache_key(model: str) -> Column:
    return F.concat(X.content_hash(F.col("title"), F.col("summary"), F.col("source")), F.lit(":"), F.lit(model))


def with_cache(items: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """Items with the cached labels (key, content_type, confidence, ...) and from_cache."""
    labels = cache.select(F.col("key").alias("_key"), *[c for c in cache.columns if c != "key"], F.lit(True).alias("_hit")).dropDuplicates(["_key"])
    out = items.drop(*[c for c in cache.columns if c != "key" and c in items.columns]).withColumn("_key", cache_key(model)).join(labels, "_key", "left")
    return out.withColumn("from_cache", F.coalesce("_hit", F.lit(False))).drop("_key", "_hit")


def url_hints(url: Column, several: bool = True) -> Column:
    low = F.lower(F.coalesce(url, F.lit("")))
    has = lambda *t: X.contains_any(low, t)
    hints = [F.when(has("arxiv", "paper"), F.lit("[PAPER]")), F.when(has("podcast"), F.lit("[PODCAST]")), F.when(has("blog"), F.lit("[BLOG]"))]
    return F.array_join(F.array_compact(F.array(*hints)), " ") if several else F.coalesce(*hints, F.lit(""))


def prompt() -> Column:
    """A prompt for one item."""
    return F.format_string("Classify this item as one of %s. Answer with one JSON object.\n%s\nTitle: %s\nSummary: %s\nSource: %s", F.lit(", ".join(TYPES)), url_hints(F.col("url")), F.left(F.coalesce("title", F.lit("")), F.lit(100)), F.left(F.coalesce("summary", F.lit("")), F.lit(300)), F.coalesce("source", F.lit("")))


def batch_prompts(items: DataFrame, size: int = 5) -> DataFrame:
    """(batch, prompt, ords, keys): numbered items, `size` at a time in their order, so only the last batch can be smaller. `keys` tell
    the items apart (schema.keys), however many share an `ord`."""
    line = F.concat(url_hints(F.col("url"), several=False), F.lit(" "), F.left(F.coalesce("title", F.lit("")), F.lit(80)), F.lit(" | "), F.left(F.coalesce("summary", F.lit("")), F.lit(120)), F.lit(" | "), F.left(F.coalesce("source", F.lit("")), F.lit(20)))
    rows = items.select("ord", F.col(keys(items)).cast("string").alias("key"), line.alias("line"))
    placed = numbered(rows, [], ["ord", "key"], Scratch(items.sparkSession, "batches"))
    per = placed.groupBy(F.floor(F.col("at") / size).alias("batch")).agg(F.array_sort(F.collect_list(F.struct("at", "ord", "key", "line"))).alias("x"))
    numbers = F.transform("x", lambda r, i: F.concat((i + 1).cast("string"), F.lit(". "), r["line"]))
    return per.select("batch", F.concat(F.lit("Classify each item; answer with a JSON array of objects with id.\n"), F.array_join(numbers, "\n")).alias("prompt"), F.transform("x", lambda r: r["ord"]).alias("ords"), F.transform("x", lambda r: r["key"]).alias("keys"))


def settled_type(name: Column, aliases: dict = L.REPLY_ALIASES) -> Column:
    """A valid content type for what a reply calls it; market if it is unknown."""
    low = F.trim(F.split_part(F.trim(F.lower(F.coalesce(name, F.lit("market")))), F.lit("("), F.lit(1)))
    return F.when(low.isin(*TYPES), low).otherwise(F.coalesce(F.try_element_at(F.from_json(F.lit(json.dumps(aliases)), "map<string,string>"), low), F.lit("market")))


def parsed_reply(reply: Column, relevance: float = 0.7) -> Column:
    """A struct of labels from the JSON object in a reply; null if there is none."""
    raw = F.regexp_replace(reply, r"```\w*", "")
    obj = F.from_json(F.nullif(F.regexp_extract(raw, r"(?s)\{.*\}", 0), F.lit("")), REPLY)
    ok = F.coalesce(obj["content_type"], obj["type"]).isNotNull()
    fields = F.coalesce(obj["tech_fields"], obj["fields"], F.array(F.lit("General AI")))
    return F.when(ok, F.struct(settled_type(F.coalesce(obj["content_type"], obj["type"])).alias("content_type"), F.coalesce(obj["confidence"], F.lit(0.8)).alias("confidence"), F.coalesce(obj["ai_relevance"], F.lit(relevance)).alias("ai_relevance"), fields.alias("tech_categories"), F.coalesce(obj["is_verified"], F.lit(True)).alias("is_verified"), F.coalesce(obj["reasoning"], obj["reason"], F.lit("")).alias("llm_reasoning")))


def type_from_text(reply: Column, terms: dict = L.REPLY_TERMS) -> Column:
    """(content_type, confidence) from free text: a category as a word of the last lines, else the one with most terms."""
    low = F.lower(F.coalesce(reply, F.lit("")))
    lines = F.split(F.trim(low), "\n")
    tail = F.split(F.array_join(F.slice(lines, F.greatest(F.size(lines) - 2, F.lit(1)), F.lit(3)), " "), r"\s+")
    named = F.try_element_at(F.filter(X.strings(terms), lambda c: F.array_contains(tail, c)), F.lit(1))
    counts = F.array(*[F.struct(X.count_hits(low, t).alias("n"), F.lit(-i).alias("order"), F.lit(c).alias("type")) for i, (c, t) in enumerate(terms.items())])
    most = F.array_max(counts)
    pair = lambda t, c: F.struct(t.alias("content_type"), c.cast("double").alias("confidence"))
    return F.when(named.isNotNull(), pair(named, F.lit(0.85))).when(most["n"] > 0, pair(most["type"], F.least(0.7 + most["n"] * 0.05, F.lit(0.9))))


def read_batch(reply: str, expected: int) -> list[dict | None]:
    """Labels by number from a reply to a batch: an array, objects by line, or any objects; the first of a number counts."""
    text = re.sub(r"```\w*", "", reply or "")

    def load(x: str):
        for candidate in (x, re.sub(r"([{,]\s*)(\w+)\s*:", r'\1"\2":', x.replace("'", '"'))):
            try:
                return json.loads(candidate)
            except ValueError:
                continue
        return None

    whole = load(text.strip())
    found = [x for x in whole if isinstance(x, dict)] if isinstance(whole, list) else []
    if not found:
        found = [o for line in text.split("\n") for o in [load(line[line.find("{") : line.rfind("}") + 1])] if isinstance(o, dict)]
    if not found:
        found = [o for m in re.findall(r"\{[^{}]*\}", text) for o in [load(m)] if isinstance(o, dict)]
    out: list[dict | None] = [None] * expected
    for i, o in enumerate(found):
        try:
            at = int(o["id"]) - 1 if o.get("id") is not None else i
            sure, about = float(o.get("confidence", 0.7)), float(o.get("ai_relevance", 0.7))
        except (TypeError, ValueError):
            continue
        kind = str(o.get("content_type", o.get("type", "market"))).lower().strip().split("(")[0].strip()
        if 0 <= at < expected and out[at] is None:
            kind = kind if kind in TYPES else L.BATCH_ALIASES.get(kind, "market")
            fields = o.get("tech_fields", o.get("fields", ["General AI"]))
            known = o.get("is_verified", True)
            out[at] = {"content_type": kind, "confidence": sure, "ai_relevance": about, "tech_categories": [str(f) for f in fields] if isinstance(fields, list) else [str(fields)], "is_verified": known if isinstance(known, bool) else True, "llm_reasoning": str(o.get("reasoning", o.get("reason", "")))}
    return out


@dataclass
class Breaker:
    """Stops calling a failing client: opens at `limit` errors, closes after `seconds`; a success clears the count."""

    limit: int = 5
    seconds: float = 60.0
    clock: Callable[[], float] = time.time
    errors: dict = field(default_factory=dict)
    opened: float | None = None

    def allows(self) -> bool:
        if self.opened is not None and self.clock() - self.opened > self.seconds:
            self.opened = None
            self.errors.clear()
        return self.opened is None

    def failed(self, reason: str) -> None:
        self.errors[reason] = self.errors.get(reason, 0) + 1
        if self.opened is None and sum(self.errors.values()) >= self.limit:
            self.opened = self.clock()

    def succeeded(self) -> None:
        self.errors.clear()

    def action(self, reason: str) -> str:
        """quick, retry or full_rule, by `RULES`."""
        rule = RULES.get(reason, Rule("full_rule"))
        if rule.counted:
            self.failed(reason)
        spent = self.opened is not None if rule.counted else self.errors.get(reason, 0) >= rule.most
        return "full_rule" if spent else rule.otherwise


@dataclass(frozen=True)
class Rule:
    """What follows a failure: `otherwise`, or full_rule once the breaker is open (`counted`: asking counts as an error) or the reason has
    come `most` times."""

    otherwise: str
    counted: bool = False
    most: float = float("inf")


#: Reasons of failures.
RULES = {
    "timeout": Rule("quick"), "connection_error": Rule("retry", counted=True), "api_error": Rule("retry", counted=True), "parse_error": Rule("retry", most=2),
    "invalid_response": Rule("retry", most=2), "rate_limit": Rule("retry"), "model_error": Rule("full_rule"),
}


class RateLimited(Exception):
    """The client must wait."""


class ApiError(Exception):
    """The client's service failed."""


class InvalidResponse(Exception):
    """The client's service answered something that is no reply."""


#: The reason of an exception: the first kind that it is of; others are model errors.
REASONS = ((TimeoutError, "timeout"), (ConnectionError, "connection_error"), (RateLimited, "rate_limit"), (ApiError, "api_error"), (InvalidResponse, "invalid_response"), (ValueError, "parse_error"))


def _reply(own: Breaker, client: Callable[[str], str], prompt: str) -> tuple[str | None, str | None]:
    """(reply, None) or (None, the reason why there is none), after a second attempt where the breaker allows it. A reply that is no
    text, or none at all, is an invalid response."""
    reason = "circuit_breaker"
    for _ in range(2):
        if not own.allows():
            break
        try:
            reply = client(prompt)
            if not isinstance(reply, str) or not reply.strip():
                raise InvalidResponse
            own.succeeded()
            return reply, None
        except Exception as e:  # noqa: BLE001  a client may raise anything
            reason = next((name for kind, name in REASONS if isinstance(e, kind)), "model_error")
        if not RULES[reason].counted and reason != "rate_limit":
            own.failed(reason)
        if own.action(reason) != "retry":
            break
    return None, reason


def asked(prompts: DataFrame, client: Callable[[str], str], breaker: Callable[[], Breaker] = Breaker) -> DataFrame:
    """`prompts` (prompt and keys) with `reply` and `reason`: each partition asks through its own breaker."""
    keys = [c for c in prompts.columns if c != "prompt"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = breaker()
        for pdf in batches:
            got = [_reply(own, client, p) for p in pdf.prompt]
            yield pdf[keys].assign(reply=pd.Series([g[0] for g in got], pdf.index, object), reason=pd.Series([g[1] for g in got], pdf.index, object))

    schema = ", ".join(f"`{c}` {prompts.schema[c].dataType.simpleString()}" for c in keys)
    return prompts.mapInPandas(run, f"{schema}, reply string, reason string")


#: What a model says of an item.
LABELS = {"content_type": "string", "confidence": "double", "ai_relevance": "double", "tech_categories": "array<string>", "is_verified": "boolean", "llm_reasoning": "string"}


def parsed_batches(replies: DataFrame) -> DataFrame:
    """(key, ord and `LABELS`) of every item of (ords, reply, and keys where it has them) rows that a reply labels."""
    keyed = replies if "keys" in replies.columns else replies.withColumn("keys", F.transform("ords", lambda o: o.cast("string")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, o, *x.values()) for names, ords, reply in zip(pdf["keys"], pdf.ords, pdf.reply, strict=True) for k, o, x in zip(names, ords, read_batch(reply, len(ords)), strict=True) if x]
            yield pd.DataFrame(rows, columns=["key", "ord", *LABELS])

    return keyed.select("keys", "ords", "reply").where("reply is not null").mapInPandas(run, "key string, ord long, " + ", ".join(f"{c} {t}" for c, t in LABELS.items()))


def single_labels(replies: DataFrame) -> DataFrame:
    """(key, `LABELS`) of (key, reply) rows, each reply to a prompt for one item: its object, or a category that its text names."""
    x, told = parsed_reply(F.col("reply")), type_from_text(F.col("reply"))
    plain = F.struct(told["content_type"].alias("content_type"), told["confidence"].alias("confidence"), F.lit(0.7).alias("ai_relevance"), F.array(F.lit("General AI")).alias("tech_categories"), F.lit(True).alias("is_verified"), F.lit("").alias("llm_reasoning"))
    return replies.select("key", F.when(x.isNotNull(), x).when(told.isNotNull(), plain).alias("x")).where("x is not null").select("key", "x.*")


def _by(model: str, reason: Column) -> Column:
    return F.when(reason == "circuit_breaker", "rule:circuit_breaker").otherwise(F.concat(F.lit("rule:fallback:"), F.coalesce(reason, F.lit("parse_error"))))


def label(items: DataFrame, rules: DataFrame, client: Callable[[str], str], model: str, cache: DataFrame | None = None, size: int = 5, retry: bool = True) -> tuple[DataFrame, DataFrame]:
    """(labels, learned) of every item: from the cache, then from batches of `size` (1: one by one), then, for what a batch's reply lacks, one
    by one (`retry`), then from `rules` (keys and labels). `labels` has key, ord, `LABELS`, from_cache and classified_by;
    `learned` has the new rows of the cache: key and `LABELS`. A client is asked once for each prompt: its replies are tables."""
    scratch, on = Scratch(items.sparkSession, "labels"), keys(items, rules)
    rows = items.select(F.col(on).cast("string").alias("key"), "ord", "title", "summary", "source", "url", cache_key(model).alias("cached"))
    if on == "item":
        rows = rows.withColumn("item", F.col("key"))
    parts, todo = [], rows
    if cache is not None:
        known = cache.select(F.col("key").alias("cached"), *[F.col(c) if c in cache.columns else F.lit(None).cast(t).alias(c) for c, t in LABELS.items()]).dropDuplicates(["cached"])
        parts.append(rows.select("key", "ord", "cached").join(known, "cached").select("key", "ord", *LABELS, F.lit(True).alias("from_cache"), F.lit(f"llm:{model}").alias("by")))
        todo = scratch.table("todo", rows.join(known, "cached", "left_anti"))
    told, reasons = [], None
    left = todo
    if size > 1:
        replies = scratch.table("batches", asked(batch_prompts(todo, size), client))
        read = scratch.table("batched", parsed_batches(replies).drop("ord").dropDuplicates(["key"]))
        told.append(read.withColumn("by", F.lit(f"llm:{model}:batch")))
        reasons = replies.select(F.explode("keys").alias("key"), "reason")
        left = todo.join(read, "key", "left_anti")
    if size == 1 or retry:
        # An item of a batch without any reply isn't asked for again: the client has had its attempts.
        again = left if reasons is None else left.join(reasons.where("reason is not null"), "key", "left_anti")
        replies = scratch.table("singles", asked(again.select("key", prompt().alias("prompt")), client))
        told.append(single_labels(replies).dropDuplicates(["key"]).withColumn("by", F.lit(f"llm:{model}")))
        one = replies.where("reason is not null").select("key", "reason")
        reasons = one if reasons is None else reasons.where("reason is not null").union(one)
    every = scratch.table("told", reduce(DataFrame.unionByName, told))
    parts.append(todo.select("key", "ord").join(every, "key").select("key", "ord", *LABELS, F.lit(False).alias("from_cache"), "by"))
    lacking = todo.select("key", "ord").join(every, "key", "left_anti").join(reasons.groupBy("key").agg(F.max("reason").alias("reason")), "key", "left")
    ruled = rules.select(F.col(on).cast("string").alias("key"), *[F.col(c) if c in rules.columns else F.lit(None).cast(t).alias(c) for c, t in LABELS.items()]).dropDuplicates(["key"])
    parts.append(lacking.join(ruled, "key").select("key", "ord", *LABELS, F.lit(False).alias("from_cache"), _by(model, F.col("reason")).alias("by")))
    learned = todo.select("key", "cached").join(every.drop("by"), "key").drop("key").withColumnRenamed("cached", "key")
    newest = F.min(F.struct(*LABELS)).alias("x")  # of items with equal texts one row, whichever partition ran twice
    return reduce(DataFrame.unionByName, parts).withColumnRenamed("by", "classified_by"), learned.groupBy("key").agg(newest).select("key", "x.*")


def labelled_in_batches(items: DataFrame, rules: DataFrame, client: Callable[[str], str], model: str, size: int = 5) -> DataFrame:
    """As `labelled`, asking for `size` items at once: what a reply does not label gets its rules' labels."""
    return label(items, rules, client, model, size=size, retry=False)[0]


def labelled_and_kept(items: DataFrame, rules: DataFrame, client: Callable[[str], str], model: str, path: str, size: int = 5) -> DataFrame:
    """Labels of `items` by the cache under `path` and the client; what the client said goes into a new version of the cache, one
    row a key, the new before the old. The labels are a table before the cache moves, so a second run asks only for what is not there."""
    from tidewell.sources import sinks

    spark = items.sparkSession
    cache = sinks.read_state(spark, path, "key string, " + ", ".join(f"{c} {t}" for c, t in LABELS.items()), ("key", "content_type"))
    labels, learned = label(items, rules, client, model, cache, size)
    out = Scratch(spark, "labelled").table("labels", labels)
    sinks.merge_state(learned, cache, path, "key")
    return out


def summarised(items: DataFrame, client: Callable[[str], str] | None = None, n: int = 150) -> DataFrame:
    """(ord, short): a client's summary of title and text, or the rule's where there is no client or it fails."""
    rule = X.cut(F.coalesce("summary", "description", F.lit("")), n)
    if client is None:
        return items.select("ord", rule.alias("short"))
    prompt = F.format_string("Summarise the following in 100 characters at most:\nTitle: %s\nText: %s", F.coalesce("title", F.lit("")), F.coalesce("summary", "description", F.lit("")))
    replies = asked(items.select("ord", rule.alias("rule"), prompt.alias("prompt")), client)
    return replies.select("ord", F.coalesce(F.trim("reply"), "rule").alias("short"))


def labelled(items: DataFrame, rules: DataFrame, client: Callable[[str], str], model: str, cache: DataFrame | None = None) -> DataFrame:
    """(key, ord, `LABELS`, from_cache, classified_by): the cache, then the client, item by item, then the rules."""
    return label(items, rules, client, model, cache, size=1)[0]


def relabelled(items: DataFrame, labels: DataFrame) -> DataFrame:
    """`items` with their new `LABELS`, from_cache and classified_by; importance is scored anew on these."""
    on = keys(items)
    new = labels.select(F.col("key").alias("_key"), *LABELS, "from_cache", "classified_by")
    return items.drop(*[c for c in new.columns if c in items.columns]).join(new, F.col(on).cast("string") == F.col("_key")).drop("_key")
