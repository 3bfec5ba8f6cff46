"""Scalar functions as column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..settings import BLOCKED_DOMAINS, SECTION_PARTS
from .lookups import QUAD_WEIGHTS, lookup


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def blank_to_null(x) -> Column:
    """Trimmed text, null if nothing is left."""
    t = F.regexp_replace(_c(x), r"^\s+|\s+$", "")
    return F.when(t != "", t)


def number(x, kind: str) -> Column:
    """A number, null for blank and for malformed text (see ``malformed``)."""
    return blank_to_null(x).try_cast(kind)


def malformed(x, kind: str) -> Column:
    """Whether text is there that is no number of the kind."""
    t = blank_to_null(x)
    return t.isNotNull() & t.try_cast(kind).isNull()


def code(x, longest: int) -> Column:
    """Upper-case code; null (not cut) if it is longer than allowed."""
    t = F.upper(blank_to_null(x))
    return F.when(F.length(t) <= longest, t)


def semicolon_list(x) -> Column:
    """The trimmed, non-empty parts between semicolons; an empty list for null."""
    parts = F.transform(F.split(F.coalesce(_c(x), F.lit("")), ";"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda p: p != "")


def day(x) -> Column:
    """The date of an integer YYYYMMDD; null if it is none."""
    return F.try_to_timestamp(_c(x).cast("string"), F.lit("yyyyMMdd")).cast("date")


def stamp(x) -> Column:
    """The time of an integer YYYYMMDDHHMMSS; null if it is none."""
    return F.try_to_timestamp(_c(x).cast("string"), F.lit("yyyyMMddHHmmss"))


def iso_day(x) -> Column:
    """YYYYMMDD as YYYY-MM-DD; text of another length as it stands."""
    t = _c(x).cast("string")
    return F.when(F.length(t) == 8, F.concat_ws("-", F.substring(t, 1, 4), F.substring(t, 5, 2), F.substring(t, 7, 2))).otherwise(t)


def normal_stamp(x) -> Column:
    """Eight digits (a day) become its first second; 14 digits stay; anything else is null."""
    t = F.trim(_c(x).cast("string"))
    return F.when(t.rlike(r"^\d{8}$"), F.concat(t, F.lit("000000"))).when(t.rlike(r"^\d{14}$"), t).try_cast("long")


def domain_plain(url) -> Column:
    """What stands between // and the next slash, lower case; empty if there is no //."""
    return F.lower(F.split_part(F.split_part(_c(url), F.lit("//"), F.lit(2)), F.lit("/"), F.lit(1)))


def domain(url) -> Column:
    """The network location of a URL, lower case, with port and user; empty if there is none."""
    return F.lower(F.regexp_extract(_c(url), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1))


def source_name(url) -> Column:
    """The domain without a leading www.; null if there is none."""
    d = F.regexp_replace(domain(url), r"^www\.", "")
    return F.when(d != "", d)


def is_section(url) -> Column:
    """Whether a section part stands anywhere in the URL, whatever its case."""
    low = F.lower(_c(url))
    return reduce(lambda a, b: a | b, (F.contains(low, F.lit(s)) for s in SECTION_PARTS))


def is_blocked(url) -> Column:
    return domain_plain(url).isin(*BLOCKED_DOMAINS)


def topic_score(events, articles, mentions, sources) -> Column:
    parts = ((0.4, events), (0.3, articles), (0.2, mentions), (0.1, sources))
    return F.round(reduce(lambda a, b: a + b, (F.lit(w) * F.log(_c(x) + F.lit(1.0)) for w, x in parts)), 4)


def component_score(events, urls, domains) -> Column:
    return F.round(F.lit(0.5) * F.log(_c(events) + F.lit(1.0)) + F.lit(0.3) * F.log(_c(urls) + F.lit(1.0)) + F.lit(0.2) * F.log(_c(domains) + F.lit(1.0)), 4)


def round2(x: Column) -> Column:
    """Two decimals, halves up, by the same double arithmetic on every engine."""
    return F.floor(x * 100.0 + 0.5) / 100.0


def severity(quad, goldstein, tone) -> Column:
    """Quad weight, plus half of what goldstein is below zero, plus 0.3 of the tone's size; at most 20, two decimals; nulls count as 0."""
    weight = F.coalesce(lookup(_c(quad), QUAD_WEIGHTS), F.lit(0.0))
    below = F.greatest(F.lit(0.0), -F.coalesce(_c(goldstein), F.lit(0.0)))
    return round2(F.least(weight + below * 0.5 + F.abs(F.coalesce(_c(tone), F.lit(0.0))) * 0.3, F.lit(20.0)))


def mean2(x) -> Column:
    """Aggregate: the mean of two-decimal values with two decimals, summed exactly."""
    d = _c(x).cast("decimal(20,2)")
    return F.round(F.sum(d).cast("double") / F.count(d), 2)


def cluster_id(ids) -> Column:
    """The first 24 hex digits of the sha256 of the numerically sorted ids, comma-joined."""
    return F.substring(F.sha2(F.array_join(F.array_sort(ids), ","), 256), 1, 24)


def day_gap(start_a, end_a, start_b, end_b) -> Column:
    """Days between two date ranges, 0 if they touch or overlap; null if a bound is null."""
    some_null = _c(start_a).isNull() | _c(end_a).isNull() | _c(start_b).isNull() | _c(end_b).isNull()
    gap = F.greatest(F.lit(0), F.datediff(day(start_b), day(end_a)), F.datediff(day(start_a), day(end_b)))
    return F.when(~some_null, gap)


def normal_domain(x) -> Column:
    """Lower case, without scheme, path and a leading www."""
    t = F.lower(F.trim(_c(x)))
    host = F.when(F.contains(t, F.lit("://")), F.split_part(F.split_part(t, F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1))).otherwise(t)
    return F.regexp_replace(host, r"^www\.", "")
