"""All terms of all vocabularies in one pass over an item's text.

A `Lexicon` numbers the distinct terms of its vocabularies. `Lexicon.column` scans each item once with an Aho-Corasick automaton,
in Arrow batches, and gives a row for every term that occurs: its number, how often it occurs in each part of the item
(without overlaps, as counting by replacement does), its first place and, for terms that ask for it, all places. Every scorer is then a
built-in expression over that one column, whose cost follows the terms found, not the size of the vocabularies.

A `Part` reads the column for one part of the item, or several; `Plain` has the same methods on any text column, a
search of its own for every term, for short texts and few terms.

Cases: null fields are empty; an item without any term has an empty list; repeated terms are one; an empty term is an error, as it
is in every text; texts of any length are scanned whole.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterable, Iterator, Mapping
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.functions import text as X

#: Parts of the scanned text: title, title, summary, source, url and author, a blank between each two.
PARTS = ("title", "summary", "full", "twice", "text", "body", "source", "url", "name", "author")
#: Rows are scanned in slices of about so many characters: places of terms take some hundred bytes each before they are counted.
SLICE = 1 << 18
TYPE = f"array<struct<term:int,{','.join(f'{p}:int' for p in PARTS)},first:int,places:array<int>>>"


@functools.lru_cache(maxsize=16)
def _automaton(terms: tuple[str, ...]):
    """The automaton, each term's length and whether a term can overlap itself; once for a worker and vocabulary."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for i, t in enumerate(terms):
        found.add_word(t, i)
    found.make_automaton()
    bordered = np.array([any(t.startswith(t[i:]) for i in range(1, len(t))) for t in terms])
    return found, np.array([len(t) for t in terms], np.int64), bordered


def spans(title: np.ndarray, summary: np.ndarray, rest: np.ndarray, source: np.ndarray, url: np.ndarray, author: np.ndarray) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """First and last place (after it) of every part, from the lengths of the fields; `rest` is the summary's end that `text` leaves out."""
    a, b = title + 1, 2 * title + 2
    end = b + summary
    src, link = end + 1 + source, end + 2 + source + url
    zero = np.zeros_like(a)
    return {"title": (a, b - 1), "summary": (b, end), "full": (a, end), "twice": (zero, end), "text": (a, end - rest), "body": (a, src), "source": (end + 1, src), "url": (src + 1, link), "name": (end + 1, link), "author": (link + 1, link + 1 + author)}


def scan(terms: tuple[str, ...], placed: np.ndarray, columns: list[list[str]], rest: np.ndarray) -> pa.ListArray:
    """`TYPE` of a batch: (title, summary, source, url, author) as columns, and how many characters at each summary's end are its description."""
    machine, sizes, bordered = _automaton(terms)
    n = len(rest)
    if not terms or not n:
        return pa.array([[]] * n, _arrow_type())
    # a row's (place, term) go straight into an array: as tuples they would take six times the memory
    found = [np.fromiter(chain.from_iterable(machine.iter(" ".join((row[0], *row)))), np.int64).reshape(-1, 2) for row in zip(*columns, strict=True)]
    row, flat = np.repeat(np.arange(n), [len(x) for x in found]), np.concatenate(found)
    del found
    term = flat[:, 1]
    start = flat[:, 0] + 1 - sizes[term]
    order = np.lexsort((start, term, row))
    row, term, start = row[order], term[order], start[order]
    end = start + sizes[term]
    new = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (term[1:] != term[:-1]))) if len(row) else np.zeros(0, np.int64)
    upto = np.append(new, len(row))
    lengths = [np.array([len(x) for x in c], np.int64) for c in columns]
    where = spans(lengths[0], lengths[1], rest, *lengths[2:])
    numbers, within = {}, {}
    odd = np.flatnonzero(bordered[term[new]])
    for part, (low, high) in where.items():
        inside = within[part] = (start >= low[row]) & (end <= high[row])
        number = np.add.reduceat(inside.astype(np.int64), new) if len(new) else new
        for g in odd.tolist():  # occurrences that overlap the one before don't count
            at, last = 0, -1
            for i in range(upto[g], upto[g + 1]):
                if inside[i] and start[i] >= last:
                    at, last = at + 1, end[i]
            number[g] = at
        numbers[part] = number
    place = np.where(within["full"], start - where["full"][0][row], 2**31 - 1)
    first = np.minimum.reduceat(place, new) if len(new) else new
    listed = within["full"] & placed[term]
    each = np.add.reduceat(listed.astype(np.int64), new) if len(new) else new
    ends = np.append(0, np.cumsum(each)).astype(np.int32)
    places = pa.ListArray.from_arrays(pa.array(ends), pa.array(place[listed].astype(np.int32)))
    fields = [pa.array(term[new].astype(np.int32)), *[pa.array(numbers[p].astype(np.int32)) for p in PARTS], pa.array(first.astype(np.int32), mask=first == 2**31 - 1), places]
    hits = pa.StructArray.from_arrays(fields, ["term", *PARTS, "first", "places"])
    rows = np.append(0, np.cumsum(np.bincount(row[new], minlength=n))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(rows), hits)


def sliced(terms: tuple[str, ...], placed: np.ndarray, columns: tuple[pa.Array, ...], size: int = SLICE) -> Iterator[pa.ListArray]:
    """`scan` of a batch (the last column is `rest`), by runs of rows of at most `size` characters, or of one longer row. What it holds at once
    follows the slice, however many rows a batch has."""
    import pyarrow.compute as pc

    sizes = sum(pc.utf8_length(c).to_numpy(zero_copy_only=False).astype(np.int64) + 1 for c in columns[:-1])
    upto, at = np.cumsum(sizes), 0
    while at < len(upto):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + size, "right")))
        part = [c.slice(at, end - at) for c in columns]
        yield scan(terms, placed, [c.to_pylist() for c in part[:-1]], part[-1].to_numpy(zero_copy_only=False).astype(np.int64))
        at = end
    if not len(upto):
        yield pa.array([], _arrow_type())


def _arrow_type() -> pa.DataType:
    return pa.list_(pa.struct([("term", pa.int32()), *[(p, pa.int32()) for p in PARTS], ("first", pa.int32()), ("places", pa.list_(pa.int32()))]))


class Lexicon:
    """The distinct terms of some vocabularies; `placed` ones keep all their places."""

    def __init__(self, *vocabularies: Iterable[str], placed: Iterable[str] = ()):
        placed = tuple(placed)
        self.terms = tuple(dict.fromkeys(t for v in (*vocabularies, placed) for t in v))
        if "" in self.terms:
            raise ValueError("an empty term is in every text")
        self.at, own = {t: i for i, t in enumerate(self.terms)}, set(placed)
        self.placed = np.array([t in own for t in self.terms], bool)
        #: Names the column, so that expressions never read numbers of another lexicon.
        self.name = f"_hits_{zlib.crc32(json.dumps([self.terms, sorted(own)]).encode()):08x}"

    def column(self) -> Column:
        """The scan, on the columns that classify.with_text makes."""
        terms, placed = self.terms, self.placed

        @F.arrow_udf(TYPE)
        def hits(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
            for batch in batches:
                yield from sliced(terms, placed, batch)

        return hits("_title", "_summary", "_source", "_url", "_author", "_text")

    def weights(self, terms: Mapping[str, float]) -> Column:
        """A constant array<double>: each term's weight at its number, null for terms of other vocabularies."""
        out: list[float | None] = [None] * len(self.terms)
        for t, w in terms.items():
            out[self.at[t]] = float(w)
        return F.from_json(F.lit(json.dumps(out)), "array<double>")

    def part(self, *parts: str) -> Part:
        return Part(self, parts)


class Part:
    """What a lexicon found in a part of an item, or in any of several."""

    def __init__(self, lexicon: Lexicon, parts: tuple[str, ...]):
        self.lexicon, self.parts, self.hits = lexicon, parts, F.col(lexicon.name)

    def _in(self, hit: Column) -> Column:
        out = hit[self.parts[0]] > 0
        for p in self.parts[1:]:
            out = out | (hit[p] > 0)
        return out

    def _weight(self, terms: Mapping[str, float]):
        table = self.lexicon.weights(terms)
        return lambda hit: F.get(table, hit["term"])

    def any(self, terms: Iterable[str]) -> Column:
        weight = self._weight(dict.fromkeys(terms, 1))
        return F.exists(self.hits, lambda h: self._in(h) & weight(h).isNotNull())

    def count(self, terms: Iterable[str]) -> Column:
        weight = self._weight(dict.fromkeys(terms, 1))
        return F.size(F.filter(self.hits, lambda h: self._in(h) & weight(h).isNotNull()))

    def weighted_score(self, terms: Mapping[str, float]) -> Column:
        """Sum of weight * (1 + ln(occurrences)) over the terms, and half a point for each of them."""
        weight = self._weight(terms)
        return F.aggregate(self.hits, F.lit(0.0), lambda acc, h: acc + F.when(self._in(h) & weight(h).isNotNull(), weight(h) * (1 + F.ln(h[self.parts[0]])) + 0.5).otherwise(0.0))

    def weight_sum(self, terms: Mapping[str, float], title: Part | None = None, extra: float = 0.0) -> Column:
        """Sum of the weights of the terms, each raised by `extra` times itself if the title has it."""
        weight = self._weight(terms)
        more = (lambda h: F.when(title._in(h), 1.0 + extra).otherwise(1.0)) if title else (lambda h: F.lit(1.0))
        return F.aggregate(self.hits, F.lit(0.0), lambda acc, h: acc + F.when(self._in(h) & weight(h).isNotNull(), weight(h) * more(h)).otherwise(0.0))

    def _found(self, terms: Mapping[str, float]) -> Column:
        weight = self._weight(terms)
        return F.transform(F.filter(self.hits, lambda h: self._in(h) & weight(h).isNotNull()), weight)

    def largest(self, terms: Mapping[str, float]) -> Column:
        """The largest weight of a term, null without any."""
        return F.array_max(self._found(terms))

    def first(self, terms: Mapping[str, float]) -> Column:
        """The weight of the first of the terms, in their own order, null without any."""
        names = list(terms)
        at = F.array_min(self._found({t: i for i, t in enumerate(names)})).cast("int")
        return F.get(F.from_json(F.lit(json.dumps([float(terms[t]) for t in names])), "array<double>"), at)

    def negation(self, terms: Mapping[str, float], actions: Iterable[str], reach: int = 40, most: float = 5.0) -> Column:
        """Weights of all occurrences of negating terms: whole near an action, else half; capped. Terms and actions are `placed`."""
        acts, weight = dict.fromkeys(actions, 1), self._weight(terms)
        sizes = self.lexicon.weights({t: len(t) for t in {*terms, *acts}})
        size = lambda h: F.get(sizes, h["term"]).cast("int")
        acting = self._weight(acts)
        near = F.flatten(F.transform(F.filter(self.hits, lambda h: acting(h).isNotNull()), lambda h: F.transform(h["places"], lambda p: F.struct(p.alias("low"), (p + size(h)).alias("high")))))

        def one(h: Column) -> Column:
            start = F.struct(F.lit(0).alias("at"), F.lit(0.0).alias("sum"))

            def step(acc: Column, p: Column) -> Column:
                worth = F.when(F.exists(near, lambda a: (a["low"] >= p - reach) & (a["high"] <= p + reach)), weight(h)).otherwise(weight(h) * 0.5)
                free = p >= acc["at"]  # an occurrence that overlaps the one before is none
                return F.struct(F.when(free, p + size(h)).otherwise(acc["at"]).alias("at"), F.when(free, acc["sum"] + worth).otherwise(acc["sum"]).alias("sum"))

            return F.aggregate(h["places"], start, step)["sum"]

        hits = F.filter(self.hits, lambda h: self._in(h) & weight(h).isNotNull())
        return F.least(F.lit(most), F.aggregate(F.transform(hits, one), F.lit(0.0), lambda a, x: a + x))


class Plain:
    """The same on a text column."""

    def __init__(self, text: Column):
        self.text = text

    def any(self, terms: Iterable[str]) -> Column:
        return X.contains_any(self.text, terms)

    def count(self, terms: Iterable[str]) -> Column:
        return X.count_hits(self.text, terms)

    def weighted_score(self, terms: Mapping[str, float]) -> Column:
        return X.weighted_score(self.text, terms)

    def weight_sum(self, terms: Mapping[str, float], title: Plain | None = None, extra: float = 0.0) -> Column:
        return X.weight_sum(self.text, terms, title.text if title else None, extra)

    def largest(self, terms: Mapping[str, float]) -> Column:
        return F.array_max(F.transform(F.filter(X.weighted(terms), lambda t: F.contains(self.text, t["term"])), lambda t: t["weight"]))

    def first(self, terms: Mapping[str, float]) -> Column:
        return F.try_element_at(F.filter(X.weighted(terms), lambda t: F.contains(self.text, t["term"])), F.lit(1))["weight"]


def matcher(text: Column | Part | Plain) -> Part | Plain:
    return Plain(text) if isinstance(text, Column) else text
