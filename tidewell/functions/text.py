"""Column functions on text: term matching, scores, normal forms, dates. All are built-in expressions."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.lexicons import LOWER_TITLE_SUFFIX, STOPWORDS, TITLE_SUFFIX, TRACKING_KEYS

#: Letters, digits and underscores of any script; the same class in Java and RE2.
NOT_WORD = r"[^\p{L}\p{N}_\s]"


def weighted(terms: Mapping[str, float]) -> Column:
    """A constant array<struct<term, weight>> in the order of `terms`."""
    return F.from_json(F.lit(json.dumps([{"term": t, "weight": float(w)} for t, w in terms.items()])), "array<struct<term:string,weight:double>>")


def strings(terms: Iterable[str]) -> Column:
    return F.from_json(F.lit(json.dumps(list(terms))), "array<string>")


def contains_any(text: Column, terms: Iterable[str]) -> Column:
    return F.exists(strings(terms), lambda t: F.contains(text, t))


def count_hits(text: Column, terms: Iterable[str]) -> Column:
    return F.size(F.filter(strings(terms), lambda t: F.contains(text, t)))


def occurrences(text: Column, term: Column) -> Column:
    """Non-overlapping occurrences."""
    return (F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)


def weighted_score(text: Column, terms: Mapping[str, float]) -> Column:
    """Sum of weight * (1 + ln(occurrences)) over contained terms, and half a point for each of them."""
    hits = F.filter(weighted(terms), lambda t: F.contains(text, t["term"]))
    return F.aggregate(hits, F.lit(0.0), lambda acc, t: acc + t["weight"] * (1 + F.ln(occurrences(text, t["term"]))) + 0.5)


def weight_sum(text: Column, terms: Mapping[str, float], title: Column | None = None, extra: float = 0.0) -> Column:
    """Sum of the weights of contained terms, each raised by `extra` times itself if the title has it."""
    hits = F.filter(weighted(terms), lambda t: F.contains(text, t["term"]))
    more = (lambda t: F.when(F.contains(title, t["term"]), 1.0 + extra).otherwise(1.0)) if title is not None else (lambda t: F.lit(1.0))
    return F.aggregate(hits, F.lit(0.0), lambda acc, t: acc + t["weight"] * more(t))


def first_contained(text: Column, names: Iterable[str]) -> Column:
    """The first of `names` that the text contains."""
    return F.try_element_at(F.filter(strings(names), lambda t: F.contains(text, t)), F.lit(1))


def phrase_count(text: Column, patterns: Iterable[str]) -> Column:
    """How many of the patterns occur, case aside."""
    total = F.lit(0)
    for p in patterns:
        total = total + text.rlike(f"(?iu){p}").cast("int")
    return total


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def cut(text: Column, n: int) -> Column:
    """At most n characters, with an ellipsis if something is left out."""
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("..."))).otherwise(text)


def escaped(html: Column) -> Column:
    """Tags out, white space collapsed, special characters escaped."""
    text = collapse(F.regexp_replace(html, r"<[^>]+>", " "))
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def normal_url(url: Column, tracking: Iterable[str] = TRACKING_KEYS) -> Column:
    """Scheme and authority in lower case, no slash at the path's end, no fragment, no tracking keys; the query is decoded
    and encoded again, with the values of one key together and an equals sign after every key. An address with an
    unmatched bracket only loses its last slashes."""
    clean = F.regexp_replace(F.regexp_replace(url, r"[\t\r\n]", ""), r"^[\x00-\x20]+", "")
    part = lambda n: F.regexp_extract(clean, r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?", n)
    scheme, authority, path = F.lower(part(1)), F.lower(part(2)), part(3)
    # '+' is a blank; a '%' that is no escape stays.
    decoded = lambda x: F.url_decode(F.regexp_replace(x, "%(?![0-9A-Fa-f]{2})", "%25"))
    encoded = lambda x: F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    pair = lambda x: F.struct(decoded(F.regexp_extract(x, "^[^=]*", 0)).alias("key"), decoded(F.regexp_replace(x, "^[^=]*=?", "")).alias("value"))
    pairs = F.filter(F.transform(F.filter(F.split(part(4), "&"), lambda x: x != ""), pair), lambda p: ~F.array_contains(strings(tracking), F.lower(p["key"])))
    names = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    grouped = F.flatten(F.transform(names, lambda k: F.filter(pairs, lambda p: p["key"] == k)))
    query = F.array_join(F.transform(grouped, lambda p: F.concat(encoded(p["key"]), F.lit("="), encoded(p["value"]))), "&")
    # Parameters after a ';' in the last segment stay; slashes before them go.
    params = F.regexp_extract(path, r"^(?:.*/)?[^/;]*(;[^/]*)$", 1)
    plain = F.regexp_replace(F.left(path, F.length(path) - F.length(params)), "/+$", "")
    before = F.concat(F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""), F.when(authority != "", F.concat(F.lit("//"), authority)).otherwise(""))
    whole = F.concat(before, plain, F.when(params != ";", params).otherwise(""), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(F.contains(authority, F.lit("[")) != F.contains(authority, F.lit("]")), F.regexp_replace(url, "/+$", "")).otherwise(whole)


def normal_title(title: Column) -> Column:
    """Without a capitalised source suffix, in lower case, marks as blanks, white space collapsed."""
    text = F.regexp_replace(title, TITLE_SUFFIX, "")
    return collapse(F.regexp_replace(F.lower(text), NOT_WORD, " "))


def cache_title(title: Column, n: int = 60) -> Column:
    """Lower case before the suffix goes, and at most n characters: a key that survives cut titles."""
    text = F.regexp_replace(F.lower(title), LOWER_TITLE_SUFFIX, "")
    return F.trim(F.left(collapse(F.regexp_replace(text, NOT_WORD, " ")), F.lit(n)))


def keywords(title: Column, stop: Iterable[str] = STOPWORDS) -> Column:
    words = F.split(normal_title(title), " ")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~F.array_contains(strings(stop), w)))


def fingerprint(url: Column, title: Column) -> Column:
    return F.md5(F.lower(F.concat(F.coalesce(url, F.lit("")), F.lit("|"), F.left(F.coalesce(title, F.lit("")), F.lit(50)))))


def content_hash(title: Column, summary: Column, source: Column) -> Column:
    return F.md5(F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in (title, summary, source)]))


def parsed_date(text: Column) -> Column:
    """A timestamp from RFC 822 or ISO text; null if it is neither."""
    rfc = F.regexp_replace(F.regexp_replace(text, r"^[A-Za-z]{3},\s*", ""), r"\bGMT$", "+0000")
    forms = [F.try_to_timestamp(rfc, F.lit("d MMM yyyy HH:mm:ss xx")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))]
    return F.coalesce(*forms, text.try_cast("timestamp"))


def decay_days(at: Column, now: Column) -> Column:
    """Whole days between two timestamps, rounded down."""
    return F.floor((F.unix_timestamp(now) - F.unix_timestamp(at)) / 86400)


def negation(text: Column, terms: Mapping[str, float], actions: Iterable[str], reach: int = 40, most: float = 5.0) -> Column:
    """Weights of all occurrences of negating terms: whole near an action, else half; capped."""
    acts = strings(actions)

    def one(t: Column) -> Column:
        pieces = F.split(text, F.concat(F.lit("\\Q"), t["term"], F.lit("\\E")), -1)
        lengths = F.transform(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p: F.length(p) + F.length(t["term"]))
        # Running sums as a fold: (end of the last occurrence, points so far).
        start = F.struct(F.lit(0).alias("at"), F.lit(0.0).alias("sum"))

        def step(acc: Column, n: Column) -> Column:
            at = acc["at"] + n - F.length(t["term"])
            low = F.greatest(at - reach, F.lit(0))
            near = F.substring(text, low + 1, at + reach - low)
            worth = F.when(F.exists(acts, lambda a: F.contains(near, a)), t["weight"]).otherwise(t["weight"] * 0.5)
            return F.struct((acc["at"] + n).alias("at"), (acc["sum"] + worth).alias("sum"))

        return F.aggregate(lengths, start, step)["sum"]

    hits = F.filter(weighted(terms), lambda t: F.contains(text, t["term"]))
    return F.least(F.lit(most), F.aggregate(F.transform(hits, one), F.lit(0.0), lambda a, x: a + x))
