"""The text functions as DuckDB SQL, for the oracle queries."""

from __future__ import annotations

from collections.abc import Iterable, Mapping


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strings(terms: Iterable[str]) -> str:
    return "[" + ", ".join(map(quoted, terms)) + "]"


def weighted(terms: Mapping[str, float]) -> str:
    return "[" + ", ".join(f"{{'term': {quoted(t)}, 'weight': CAST({float(w)} AS DOUBLE)}}" for t, w in terms.items()) + "]"


def contains_any(text: str, terms: Iterable[str]) -> str:
    return f"(len(list_filter({strings(terms)}, lambda t: contains({text}, t))) > 0)"


def count_hits(text: str, terms: Iterable[str]) -> str:
    return f"len(list_filter({strings(terms)}, lambda t: contains({text}, t)))"


def weighted_score(text: str, terms: Mapping[str, float]) -> str:
    tf = f"((length({text}) - length(replace({text}, t.term, ''))) / length(t.term))"
    return f"coalesce(list_sum(list_transform(list_filter({weighted(terms)}, lambda t: contains({text}, t.term)), lambda t: t.weight * (1 + ln({tf})) + 0.5)), 0.0)"


def weight_sum(text: str, terms: Mapping[str, float], title: str | None = None, extra: float = 0.0) -> str:
    more = f" * CASE WHEN contains({title}, t.term) THEN {1 + extra} ELSE 1.0 END" if title else ""
    return f"coalesce(list_sum(list_transform(list_filter({weighted(terms)}, lambda t: contains({text}, t.term)), lambda t: t.weight{more})), 0.0)"


def phrase_count(text: str, patterns: Iterable[str]) -> str:
    return "(" + " + ".join(f"CAST(regexp_matches({text}, {quoted('(?i)' + p)}) AS INT)" for p in patterns) + ")"


def collapse(text: str) -> str:
    return f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))"


NOT_WORD = r"[^\p{L}\p{N}_\s]"


def normal_title(title: str) -> str:
    cut = f"regexp_replace({title}, {quoted(chr(92) + 's*[-|—]' + chr(92) + 's*[A-Z][a-zA-Z' + chr(92) + 's&.' + chr(39) + ']+$')}, '')"
    return collapse(f"regexp_replace(lower({cut}), '{NOT_WORD}', ' ', 'g')")


def cache_title(title: str) -> str:
    cut = f"regexp_replace(lower({title}), {quoted(chr(92) + 's*[-|—]' + chr(92) + 's*[a-z][a-z' + chr(92) + 's&.' + chr(39) + ']+$')}, '')"
    return f"trim(left({collapse(f'regexp_replace({cut}, {quoted(NOT_WORD)}, {quoted(chr(32))}, {quoted(chr(103))})')}, 60))"


def keywords(title: str, stop: Iterable[str]) -> str:
    return f"list_distinct(list_filter(string_split({normal_title(title)}, ' '), lambda w: length(w) >= 3 AND NOT list_contains({strings(stop)}, w)))"
