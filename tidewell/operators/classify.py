"""Rule classification: relevance, content type, confidence, fields, region. Staged column expressions over one scan of the text."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell import lexicons as L
from tidewell.functions import text as X
from tidewell.functions.lexicon import Lexicon
from tidewell.operators import importance


@dataclass(frozen=True)
class Vocabulary:
    """Everything that the rules match against; replace any part for another domain."""

    types: dict = field(default_factory=lambda: {"research": L.RESEARCH, "developer": L.DEVELOPER, "product": L.PRODUCT, "market": L.MARKET, "leader": L.LEADER})
    phrases: dict = field(default_factory=lambda: L.PHRASES)
    priors: dict = field(default_factory=lambda: L.PRIORS)
    strong_research: tuple = L.STRONG_RESEARCH
    companies: tuple = L.COMPANIES
    products: tuple = L.PRODUCTS
    tech: dict = field(default_factory=lambda: L.TECH)
    regions: dict = field(default_factory=lambda: L.REGIONS)
    core: dict = field(default_factory=lambda: L.CORE_TERMS)
    field_products: dict = field(default_factory=lambda: L.PRODUCT_TERMS)
    weak: dict = field(default_factory=lambda: L.WEAK_TERMS)
    off_topic: tuple = L.OFF_TOPIC
    negations: dict = field(default_factory=lambda: L.NEGATIONS)
    actions: tuple = L.ACTIONS
    trusted: tuple = L.TRUSTED


def low(name: str) -> Column:
    return F.lower(F.coalesce(F.col(name), F.lit("")))


def lexicon(v: Vocabulary = Vocabulary()) -> Lexicon:  # noqa: B008
    """Every term that classification or importance looks for in an item."""
    sources = [t for t in v.priors if t != "_default"]
    groups = (*v.types.values(), v.core, v.field_products, v.weak, v.off_topic, v.strong_research, v.companies, v.products, *v.tech.values(), *v.regions.values(), v.trusted, sources)
    return Lexicon(*groups, L.ROLES, L.GENERIC_TITLES, L.EVENTS, L.LEADER_VERBS, L.STRONG_STATEMENT, L.FIELD_SOURCES, *importance.vocabularies(), placed=(*v.negations, *v.actions))


def with_text(items: DataFrame, v: Vocabulary = Vocabulary()) -> DataFrame:  # noqa: B008
    """Lower-cased fields, once, and what the vocabulary's lexicon finds in them."""
    texts = {"_title": low("title"), "_text": F.length(low("description")) + 1, "_summary": F.lower(F.concat_ws(" ", F.coalesce("summary", F.lit("")), F.coalesce("description", F.lit("")))), "_source": low("source"), "_url": low("url"), "_author": low("author")}
    lex = lexicon(v)
    return items.withColumns(texts).withColumns({"_full": F.concat_ws(" ", "_title", "_summary"), lex.name: lex.column()})


def without_text(items: DataFrame) -> DataFrame:
    return items.drop(*[c for c in items.columns if c.startswith("_")])


def relevance(v: Vocabulary = Vocabulary()) -> Column:  # noqa: B008
    """How much an item is about the field, 0 to 1."""
    lex = lexicon(v)
    title, full = lex.part("title"), lex.part("twice")
    plus = full.weight_sum(v.core, title, 0.5) + full.weight_sum(v.field_products, title, 0.3) + full.weight_sum(v.weak)
    minus = full.weight_sum(dict.fromkeys(v.off_topic, 2.0), title, 1.5)
    base = F.least(F.lit(1.0), plus / 20.0)
    bonus = F.when(lex.part("source", "url").any(L.FIELD_SOURCES), 0.15).otherwise(0.0)
    base = F.least(F.lit(1.0), base + bonus)
    base = F.when(minus > 0, F.greatest(F.lit(0.0), base - F.least(F.lit(0.5), minus / 20.0))).otherwise(base)
    base = F.when(F.contains("_url", F.lit("arxiv.org")) | F.contains("_source", F.lit("arxiv")), F.greatest(base, F.lit(0.9))).otherwise(base)
    base = F.when(F.contains("_source", F.lit("huggingface")) | F.contains("_url", F.lit("huggingface.co")), F.greatest(base, F.lit(0.85))).otherwise(base)
    return F.round(base, 3)


def trust(v: Vocabulary = Vocabulary()) -> Column:  # noqa: B008
    return F.least(F.lit(1.0), lexicon(v).part("source", "full").count(v.trusted) * 0.2)


def prior(content_type: str, v: Vocabulary = Vocabulary()) -> Column:  # noqa: B008
    """The prior of a content type by the first source name that the source contains."""
    found = lexicon(v).part("source").first({k: p[content_type] for k, p in v.priors.items() if k != "_default"})
    return F.coalesce(found, F.lit(v.priors["_default"][content_type]))


def tech_fields(v: Vocabulary = Vocabulary()) -> Column:  # noqa: B008
    full = lexicon(v).part("full")
    found = F.array_compact(F.array(*[F.when(full.any(terms), F.lit(name)) for name, terms in v.tech.items()]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("General AI")))


def region(v: Vocabulary = Vocabulary()) -> Column:  # noqa: B008
    """A set region stays; else the region with most terms in text and source, the first of equal ones."""
    text = lexicon(v).part("body")
    hits = {name: text.count(terms) for name, terms in v.regions.items()}
    most = F.greatest(*hits.values())
    out = F.when(most == 0, F.lit("Global"))
    for name, n in hits.items():
        out = out.when(n == most, F.lit(name))
    return F.when(F.coalesce(F.col("region"), F.lit("")) != "", F.col("region")).otherwise(out)


def _scores() -> Column:
    return F.array(*[F.struct(F.col(f"_s_{c}").alias("score"), F.lit(-i).alias("order"), F.lit(c).alias("type")) for i, c in enumerate(L.CONTENT_TYPES)])


def scored(items: DataFrame, v: Vocabulary = Vocabulary()) -> DataFrame:  # noqa: B008
    """_s_<type> for each content type after all rules, and the flags that they used. Needs `with_text` of the same vocabulary."""
    s = lambda c: F.col(f"_s_{c}")
    lex = lexicon(v)
    full, title, summary = lex.part("full"), lex.part("title"), lex.part("summary")
    flags = {
        "_company": lex.part("full", "source").any(v.companies), "_product": full.any(v.products), "_strong_research": full.any(v.strong_research),
        "_known": full.any(L.ROLES), "_generic": full.any(L.GENERIC_TITLES), "_event": full.any(L.EVENTS), "_tagged": lex.part("author").any(L.ROLES),
        "_negation": full.negation(v.negations, v.actions), "_trust": trust(v),
    }
    out = items.withColumns(flags)
    colon = F.col("_title").rlike("^.{2,10}[：:].{5,}") & F.col("_known")
    out = out.withColumns({"_verb": full.any(L.LEADER_VERBS) | colon, "_strong": full.any(L.STRONG_STATEMENT) | colon})
    out = out.withColumn("_role", F.col("_known") | (F.col("_generic") & F.col("_strong")))
    out = out.withColumns({f"_s_{c}": 1.5 * title.weighted_score(v.types[c]) + summary.weighted_score(v.types[c]) for c in L.CONTENT_TYPES})
    out = out.withColumns({f"_s_{c}": (s(c) + 3.0 * X.phrase_count(F.col("_full"), v.phrases.get(c, ()))) * (1 + 0.5 * prior(c, v)) for c in L.CONTENT_TYPES})
    known = F.col("_company") | F.col("_product")
    out = out.withColumns({
        "_s_research": s("research") * F.when(prior("research", v) < 0.2, 0.7).otherwise(1.0) * F.when(~F.col("_strong_research"), F.when(known, 0.3 * 0.5).otherwise(0.3)).otherwise(1.0),
        "_s_product": F.when(s("product") > 0, s("product") * F.when(known, 2.5).otherwise(1.5)).otherwise(s("product")),
    })
    event, both = F.col("_event") & ~F.col("_strong"), F.col("_verb") & F.col("_role")
    out = out.withColumn("_branch", F.when(F.col("_tagged"), 1).when(event, 2).when(both, 3).when(s("leader") > 0, F.when(F.col("_verb") | F.col("_role"), 4).otherwise(5)).otherwise(6))
    by = lambda c, *f: s(c) * F.element_at(F.array(*[F.lit(float(x)) for x in f]), F.col("_branch"))
    out = out.withColumns({
        "_s_leader": F.when(F.col("_branch") == 1, F.greatest(s("leader") * 4.0, F.lit(20.0))).when(F.col("_branch") == 3, F.greatest(s("leader") * 3.0, F.lit(15.0))).otherwise(by("leader", 1, 0.2, 1, 0.4, 0.1, 1)),
        "_s_market": by("market", 0.5, 1.5, 0.7, 1, 1, 1), "_s_product": by("product", 0.5, 1, 0.8, 1, 1, 1), "_s_research": by("research", 0.6, 1, 1, 1, 1, 1),
    })
    f = F.greatest(F.lit(0.2), 1.0 - 0.15 * F.col("_negation"))
    doubt = F.col("_negation") > 0
    return out.withColumns({
        "_s_product": s("product") * F.when(doubt, f).otherwise(1.0) * (1 + 0.3 * F.col("_trust")),
        "_s_market": s("market") * F.when(doubt, f + 0.2).otherwise(1.0),
        "_s_research": s("research") * (1 + 0.2 * F.col("_trust")),
    })


def confidence(ranked: Column) -> Column:
    """From the scores in descending order."""
    one, two = F.element_at(ranked, 1)["score"], F.element_at(ranked, 2)["score"]
    c = F.when(one + two > 0, 0.6 * one / (one + two) + 0.4 * (one - two) / one).otherwise(0.2)
    c = F.when(one > 15, F.least(F.lit(0.95), c * 1.1)).otherwise(c)
    c = F.when((two > 0) & (one / two < 1.5), c * 0.8).otherwise(c)
    return F.round(F.least(F.lit(0.99), F.greatest(F.lit(0.1), c)), 3)


def content_type(items: DataFrame, v: Vocabulary = Vocabulary()) -> DataFrame:  # noqa: B008
    """content_type, confidence and secondary_labels. Needs `with_text` of the same vocabulary."""
    out = scored(items, v)
    ranked = F.array_sort(_scores(), lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).otherwise(b["order"] - a["order"]))
    out = out.withColumn("_ranked", ranked)
    forced = F.when(F.contains("_source", F.lit("github")) | F.contains("_full", F.lit("github.com")), "developer").when(F.contains("_source", F.lit("arxiv")) | F.contains("_full", F.lit("arxiv.org")), "research")
    none = F.element_at("_ranked", 1)["score"] <= 0
    priors = F.array_sort(F.array(*[F.struct(prior(c, v).alias("score"), F.lit(-i).alias("order"), F.lit(c).alias("type")) for i, c in enumerate(L.CONTENT_TYPES)]), lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).otherwise(b["order"] - a["order"]))
    known = F.col("_company") | F.col("_product")
    best = F.when(none, F.when(known, F.lit("product")).otherwise(F.element_at(priors, 1)["type"])).otherwise(F.element_at("_ranked", 1)["type"])
    sure = F.when(none, F.when(known, 0.3).otherwise(0.2)).otherwise(confidence(F.col("_ranked")))
    top = F.element_at("_ranked", 1)["score"]
    near = F.transform(F.filter(F.slice("_ranked", 2, 4), lambda x: (x["score"] >= 0.5 * top) & (x["score"] > 3)), lambda x: x["type"])
    full_scores = F.array(*[F.struct(F.lit(c).alias("type"), lexicon(v).part("full").weighted_score(v.types[c]).alias("score")) for c in L.CONTENT_TYPES])
    beside = lambda kind: F.transform(F.filter(full_scores, lambda x: (x["score"] > 5) & (x["type"] != kind)), lambda x: x["type"])
    out = out.withColumn("_forced", forced)
    return out.withColumns({
        "content_type": F.coalesce("_forced", best), "confidence": F.when(F.col("_forced").isNotNull(), 0.95).otherwise(sure),
        "secondary_labels": F.slice(F.when(F.col("_forced").isNotNull(), beside(F.col("_forced"))).when(none, F.array().cast("array<string>")).otherwise(near), 1, 2),
    })


def labelled(items: DataFrame, v: Vocabulary = Vocabulary()) -> DataFrame:  # noqa: B008
    """All labels of an item but its importance."""
    return without_text(labels(with_text(items, v), v))


def labels(items: DataFrame, v: Vocabulary = Vocabulary()) -> DataFrame:  # noqa: B008
    """The same of items `with_text`, whose columns stay."""
    out = content_type(items.withColumn("ai_relevance", relevance(v)), v)
    return out.withColumns({"tech_categories": tech_fields(v), "region": region(v), "needs_review": F.col("confidence") < 0.6, "classified_by": F.lit("rule")})
