"""Filtered searches over events and over clusters. One predicate builder feeds both the page and the count."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field, fields
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lookups, scalars


class FilterError(ValueError):
    """A search request that names no filter or contradicts itself."""


@dataclass(frozen=True)
class EventFilters:
    """Normalised filters of an event search; None and empty lists filter nothing."""

    date_from: int | None = None
    date_to: int | None = None
    actor1: str | list[str] | None = None
    actor2: str | list[str] | None = None
    geo_countries: list[str] = field(default_factory=list)
    event_codes: list[str] = field(default_factory=list)
    root_codes: list[str] = field(default_factory=list)
    base_codes: list[str] = field(default_factory=list)
    quad_classes: list[int] = field(default_factory=list)
    goldstein_min: float | None = None
    goldstein_max: float | None = None
    tone_min: float | None = None
    tone_max: float | None = None
    min_mentions: int | None = None
    min_sources: int | None = None
    min_articles: int | None = None
    source_domains: list[str] = field(default_factory=list)
    #: base codes and source domains are part of a request but by default select nothing.
    strict: bool = False


def request_to_filters(request: dict, interpret=None, today: datetime | None = None) -> EventFilters:
    """Normalise a raw request (country, countries, date_range, actors, event_codes, quad_classes, sentiment, impact, source).

    Countries become place codes (unknown ones are left out), actors actor codes (an unknown one filters nothing), codes are trimmed,
    sorted and unique, domains plain. ``interpret`` is a callable for free text that returns place_country, root_codes, base_codes,
    date_from and date_to; an explicit date range wins over it. A request without any filter is an error."""
    if not any(v not in (None, [], {}, "") for v in request.values()):
        raise FilterError("at least one filter must be given")
    dates = request.get("date_range") or {}
    if dates and not 1979 <= dates["from"] <= dates["to"] <= 2100:
        raise FilterError("date_range must lie in 1979 to 2100 and not run backwards")
    mood, impact = request.get("sentiment") or {}, request.get("impact") or {}
    for name, most in (("tone", 100), ("goldstein", 10)):
        lo, hi = mood.get(f"{name}_min"), mood.get(f"{name}_max")
        if any(v is not None and abs(v) > most for v in (lo, hi)) or (lo is not None and hi is not None and lo > hi):
            raise FilterError(f"{name} range is wrong")
    if any(v is not None and v < 0 for v in impact.values()):
        raise FilterError("impact thresholds must not be negative")
    domains = (request.get("source") or {}).get("domains") or []
    if len(domains) > 50:
        raise FilterError("at most 50 domains")
    said = (interpret(request) if interpret else {}) or {}
    codes, actors = request.get("event_codes") or {}, request.get("actors") or {}
    place = [said.get("place_country")] + [lookups.country_code(c, lookups.PLACE_COUNTRIES, 2) for c in request.get("countries") or []]
    unique = lambda xs: sorted({str(x).strip() for x in xs if x and str(x).strip()})
    if dates:
        date_from, date_to = dates["from"] * 10000 + 101, dates["to"] * 10000 + 1231
    else:
        date_from = said.get("date_from", 20150101)
        date_to = said.get("date_to", int((today or datetime.now(timezone.utc)).strftime("%Y%m%d")))
    return EventFilters(
        date_from=date_from, date_to=date_to,
        actor1=lookups.country_code(actors.get("actor1_country"), lookups.ACTOR_COUNTRIES, 3), actor2=lookups.country_code(actors.get("actor2_country"), lookups.ACTOR_COUNTRIES, 3),
        geo_countries=unique(place), event_codes=unique(codes.get("full_codes") or []),
        root_codes=unique([*said.get("root_codes", []), *(codes.get("root_codes") or [])]), base_codes=unique([*said.get("base_codes", []), *(codes.get("base_codes") or [])]),
        quad_classes=sorted(set(request.get("quad_classes") or [])), source_domains=sorted({plain_domain(d) for d in domains if d.strip()}), **mood, **impact,
    )


def plain_domain(text: str) -> str:
    t = text.strip().lower()
    if "://" in t:
        t = t.split("://", 1)[1].split("/", 1)[0] or t
    return t.removeprefix("www.")


def cache_key(request: dict) -> str:
    """The sha256 of the request as JSON with sorted keys and lower-case texts."""
    low = lambda v: v.strip().lower() if isinstance(v, str) else [low(x) for x in v] if isinstance(v, list) else {k: low(x) for k, x in v.items()} if isinstance(v, dict) else v
    return hashlib.sha256(json.dumps(low(request), sort_keys=True).encode()).hexdigest()


def _one_or_many(c: str, value) -> Column | None:
    if not value:
        return None
    return F.col(c) == value if isinstance(value, str) else F.col(c).isin(list(value))


def event_predicate(f: EventFilters) -> Column:
    """All filters joined by AND; TRUE if there is none. Comparisons with null select nothing, as in SQL."""
    at_least = lambda c, v: None if v is None else F.col(c) >= v
    at_most = lambda c, v: None if v is None else F.col(c) <= v
    parts = [
        at_least("sql_date", f.date_from or None), at_most("sql_date", f.date_to or None),
        _one_or_many("actor1_country_code", f.actor1), _one_or_many("actor2_country_code", f.actor2),
        _one_or_many("action_geo_country_code", list(f.geo_countries)), _one_or_many("event_code", list(f.event_codes)), _one_or_many("event_root_code", list(f.root_codes)),
        F.col("quad_class").isin(list(f.quad_classes)) if f.quad_classes else None,
        at_least("goldstein_scale", f.goldstein_min), at_most("goldstein_scale", f.goldstein_max), at_least("avg_tone", f.tone_min), at_most("avg_tone", f.tone_max),
        at_least("num_mentions", f.min_mentions), at_least("num_sources", f.min_sources), at_least("num_articles", f.min_articles),
    ]
    if f.strict:
        parts.append(_one_or_many("event_base_code", list(f.base_codes)))
        parts.append(scalars.source_name("source_url").isin(list(f.source_domains)) if f.source_domains else None)
    return reduce(lambda a, b: a & b, [p for p in parts if p is not None], F.lit(True))


def search_events(events: DataFrame, f: EventFilters, limit: int = 100, offset: int = 0) -> DataFrame:
    """One page of the events, newest first (ties: the smaller id, then the other columns' order is fixed by the source URL)."""
    order = [F.col("date_added").desc_nulls_first(), F.col("global_event_id").asc(), F.col("source_url").asc_nulls_first()]
    return events.filter(event_predicate(f)).orderBy(*order).offset(offset).limit(limit)


def count_events(events: DataFrame, f: EventFilters) -> DataFrame:
    return events.filter(event_predicate(f)).agg(F.count("global_event_id").alias("total"))


def event_view(events: DataFrame) -> DataFrame:
    """The response form of events: id as text, day as ISO text, blank texts null, the site's name from the URL."""
    text = lambda c: F.when(F.col(c) != "", F.col(c))
    names = ("actor1_country_code", "actor2_country_code", "event_code", "event_root_code", "action_geo_full_name", "action_geo_country_code", "source_url")
    return events.filter("global_event_id is not null").select(F.col("global_event_id").cast("string").alias("event_id"), scalars.iso_day("sql_date").alias("event_date"), *(text(c).alias(c) for c in names), "quad_class", "goldstein_scale", "avg_tone", "num_mentions", "num_sources", "num_articles", scalars.source_name("source_url").alias("source_name"))


@dataclass(frozen=True)
class ClusterFilters:
    """Filters of a cluster search. Both date bounds compare the first day of the cluster."""

    min_score: float | None = None
    min_events: int | None = None
    min_mentions: int | None = None
    date_from: int | None = None
    date_to: int | None = None
    mentioned_from: str | None = None
    mentioned_to: str | None = None
    status: str | None = None
    country: str | None = None
    event_type: str | None = None
    quad_class: str | None = None
    theme: str | None = None
    keyword: str | None = None
    topic: str | None = None


_CONTAINS = {"country": "dominant_countries", "event_type": "dominant_event_types", "quad_class": "dominant_quad_classes", "theme": "themes", "keyword": "keywords", "topic": "main_topics"}


def cluster_predicate(f: ClusterFilters) -> Column:
    bounds = (("topic_score", f.min_score, ">="), ("event_count", f.min_events, ">="), ("mention_count", f.min_mentions, ">="), ("event_date_ref_start", f.date_from, ">="), ("event_date_ref_start", f.date_to, "<="))
    parts = [F.col(c) >= v if op == ">=" else F.col(c) <= v for c, v, op in bounds if v is not None]
    if f.mentioned_from is not None:
        parts.append(F.col("first_mention_at") >= F.lit(f.mentioned_from).cast("timestamp"))
    if f.mentioned_to is not None:
        parts.append(F.col("last_mention_at") <= F.lit(f.mentioned_to).cast("timestamp"))
    if f.status is not None:
        parts.append(F.col("enrichment_status") == f.status)
    parts += [F.array_contains(c, getattr(f, name)) for name, c in _CONTAINS.items() if getattr(f, name) is not None]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def search_clusters(clusters: DataFrame, f: ClusterFilters, limit: int = 50, offset: int = 0, nulls_first: bool = True, most: int | None = None) -> DataFrame:
    """One page, best score first (ties: cluster_id); ``most`` clamps the limit to [1, most]."""
    if most is not None:
        limit = max(1, min(limit, most))
    score = F.col("topic_score").desc_nulls_first() if nulls_first else F.col("topic_score").desc_nulls_last()
    return clusters.filter(cluster_predicate(f)).orderBy(score, "cluster_id").offset(offset).limit(limit)


def count_clusters(clusters: DataFrame, f: ClusterFilters) -> DataFrame:
    return clusters.filter(cluster_predicate(f)).agg(F.count("*").alias("total"))


def cluster_view(clusters: DataFrame) -> DataFrame:
    """The nested response form: identity, score, event, document and text blocks."""
    block = lambda name, *cs: F.struct(*cs).alias(name)
    return clusters.select(
        "cluster_id", "source_url",
        block("score", "topic_score", "event_count", "num_articles", "num_mentions", "num_sources"),
        block("events", "event_ids", "dominant_event_types", "dominant_quad_classes", "avg_severity_score", "dominant_countries", "dominant_locations", "event_date_ref_start", "event_date_ref_end"),
        block("documents", "themes", "persons", "organizations", F.col("gkg_locations").alias("locations"), "document_tone_avg"),
        block("text", "article_title", "article_summary", "cited_sources", "main_topics", "keywords", "entities"),
        "enrichment_status", "computed_at",
    )


def filter_names() -> list[str]:
    return [f.name for f in fields(EventFilters)]
