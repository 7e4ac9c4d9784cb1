"""The whole run as one plan: deduplicate, filter by history, label, score."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidewell.operators import classify, dedup, filters, importance


def collected(items: DataFrame, history: DataFrame, quotas: dict[str, int], as_of: str, days: int = 7) -> DataFrame:
    """What a collection keeps of its items."""
    own = filters.quota(filters.valid(filters.recent(items, as_of, days)), quotas)
    return filters.new_only(dedup.across_categories(dedup.semantic(own)), history)


def labelled(items: DataFrame, as_of: str, vocabulary: classify.Vocabulary | None = None, learned: DataFrame | None = None) -> DataFrame:
    """Items with all labels and their importance, from one scan of their texts."""
    v = vocabulary or classify.Vocabulary()
    return importance.score(classify.labels(classify.with_text(items, v), v), as_of, learned, classify.lexicon(v))
