"""Typed job options with the original configuration's names and defaults.

``JobOptions.from_env()`` reads the same environment variables the original
application reads (network-only settings such as timeouts and retries are
not part of a Spark job) and applies the same rules: blank lists fall back
to the defaults, integers are clamped, invalid modes fall back.
"""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field

from .sources import fixed

KEYWORD_SEARCH, LISTING_SCAN = "keyword_search", "listing_scan"
_TRUE = {"1", "true", "yes", "on"}


def _flag(env: Mapping, name: str, default: str) -> bool:
    return str(env.get(name, default)).lower() in _TRUE


def _int(env: Mapping, name: str, default: int, floor: int) -> int:
    try:
        return max(floor, int(env.get(name, str(default))))
    except ValueError:
        return default


@dataclass(frozen=True)
class JobOptions:
    mode: str = KEYWORD_SEARCH
    current_month_only: bool = True
    resume: bool = True
    force: bool = False
    target_site: str | None = None
    page_limit: int = fixed.DEFAULT_PAGE_LIMIT
    max_pages: int = fixed.DEFAULT_MAX_PAGES
    repeat_threshold: int = fixed.DEFAULT_REPEAT_THRESHOLD
    search_keywords: list = field(default_factory=lambda: list(fixed.DEFAULT_SEARCH_KEYWORDS))
    alumni_keywords: list = field(default_factory=lambda: fixed.longest_first(fixed.DEFAULT_SEARCH_KEYWORDS))
    institution_keywords: list = field(default_factory=lambda: list(fixed.DEFAULT_INSTITUTION_KEYWORDS))
    status_keywords: list = field(default_factory=lambda: list(fixed.DEFAULT_STATUS_KEYWORDS))
    match_mode: str = fixed.MATCH_MODE_PROXIMITY
    match_window: int = fixed.DEFAULT_MATCH_WINDOW

    @classmethod
    def from_env(cls, env: Mapping | None = None) -> "JobOptions":
        env = os.environ if env is None else env
        mode = str(env.get("SCRAPER_MODE", KEYWORD_SEARCH)).strip().lower()
        match_mode = str(env.get("SCRAPER_MATCH_MODE", fixed.MATCH_MODE_PROXIMITY)).strip().lower()
        alumni_raw = env.get("SCRAPER_ALUMNI_KEYWORDS")
        if alumni_raw is None:
            alumni_raw = env.get("SCRAPER_SEARCH_KEYWORDS")
        return cls(
            mode=mode if mode in (KEYWORD_SEARCH, LISTING_SCAN) else KEYWORD_SEARCH,
            current_month_only=_flag(env, "SCRAPER_CURRENT_MONTH_ONLY", "true"),
            resume=_flag(env, "SCRAPER_RESUME_FROM_STATE", "true"),
            force=_flag(env, "SCRAPER_FORCE_RESCAN", "false"),
            target_site=(str(env.get("SCRAPER_CITY", "")).strip().lower() or None),
            page_limit=_int(env, "SCRAPER_PAGE_LIMIT", fixed.DEFAULT_PAGE_LIMIT, 1),
            max_pages=_int(env, "SCRAPER_MAX_PAGES", fixed.DEFAULT_MAX_PAGES, 1),
            repeat_threshold=_int(env, "SCRAPER_REPEATED_PAGE_STOP_THRESHOLD", fixed.DEFAULT_REPEAT_THRESHOLD, 1),
            search_keywords=fixed.parse_keyword_list(env.get("SCRAPER_SEARCH_KEYWORDS"),
                                                     fixed.DEFAULT_SEARCH_KEYWORDS),
            alumni_keywords=fixed.longest_first(fixed.parse_keyword_list(alumni_raw, fixed.DEFAULT_SEARCH_KEYWORDS)),
            institution_keywords=fixed.parse_keyword_list(env.get("SCRAPER_INSTITUTION_KEYWORDS"),
                                                          fixed.DEFAULT_INSTITUTION_KEYWORDS),
            status_keywords=fixed.parse_keyword_list(env.get("SCRAPER_STATUS_KEYWORDS"),
                                                     fixed.DEFAULT_STATUS_KEYWORDS),
            match_mode=match_mode if match_mode in (fixed.MATCH_MODE_SIMPLE, fixed.MATCH_MODE_PROXIMITY)
            else fixed.MATCH_MODE_PROXIMITY,
            match_window=_int(env, "SCRAPER_MATCH_WINDOW", fixed.DEFAULT_MATCH_WINDOW, 1),
        )
