"""Defaults of the pipeline. All values are fixed by the results that the operators must give."""

from __future__ import annotations

from dataclasses import dataclass


# Parts of a URL that mark section pages, and domains that only aggregate.
SECTION_PARTS = ("/search/", "/label/", "/category/", "/categories/", "/tag/", "/tags/", "/topic/", "/topics/", "/author/", "/authors/", "/archive/", "/archives/", "/page/")
BLOCKED_DOMAINS = ("www.yahoo.com", "www.aol.com", "www.aol.co.uk", "www.dailymail.co.uk", "www.mirror.co.uk", "www.express.co.uk", "www.winnipegfreepress.com", "www.bignewsnetwork.com", "www.miragenews.com", "www.globalsecurity.org", "www.gazetteandherald.co.uk", "www.newkerala.com", "allafrica.com", "thedailyblog.co.nz")


@dataclass(frozen=True)
class Settings:
    mention_overlap_min: int = 2
    jaccard_threshold: float = 0.4
    max_themes: int | None = 80
    max_day_gap: int = 2
    max_theme_df: float = 0.2
    themes_cap: int = 20
    persons_cap: int = 30
    organizations_cap: int = 30
    locations_cap: int = 20
    top_values: int = 5
    max_articles: int = 3
    require_mentions: bool = True
    root_event_count: int = 5000
    min_events: int = 2
    min_source_urls: int = 2
    min_domains: int = 2
    max_span_hours: float = 24.0
    min_density: float = 0.0
    stale_after: int = 3
    split_overlap: int = 2
    split_ratio: float = 0.6
    terminal_days: int = 7
    retention_days: int = 30
    window_hours: int = 36
    fallback_score: float = 3.6
    top_n: int = 20
    evidence: int = 5


DEFAULTS = Settings()
