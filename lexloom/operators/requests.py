"""Requests as rows: which of them may run, and in what terms a provider is asked.

A check gives an array of error names, empty for a valid request, so that a table of requests is judged in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions import urls as U

# Providers, and the limits of requests.
PROVIDERS = ("scholar", "courtlistener", "justia")
LAST_PAGE = {"scholar": 50, "justia": 10}
MAX_PAGES, MAX_DOWNLOADS, DEFAULT_DOWNLOADS, MAX_COLLECTED, MAX_MINUTES = 50, 1000, 5, 2000, 240
FIRST_YEAR, LAST_YEAR = 1600, 2100
SEARCH_OPTIONS = ("run_id", "refresh_of", "summarize", "browser", "search_term", "provider", "jurisdiction", "pages_to_search", "resume_page", "max_cases_to_download", "runtime_limit_minutes", "year_from", "year_to")
DIRECT_OPTIONS = {"find": ("action", "case_name", "jurisdiction", "browser"), "download": ("action", "selection_handle", "link", "summarize", "browser"), "list": ("action",)}
ACTIONS = ("collect", "resume", "refresh")


def _errors(*rules: tuple[Column, str]) -> Column:
    return F.filter(F.array(*(F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for test, name in rules)), lambda e: e.isNotNull())


def unexpected(names: Column, allowed: tuple[str, ...]) -> Column:
    """The options of a request that aren't known."""
    return F.array_except(names, F.array(*map(F.lit, allowed)))


def _blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def end_page(provider: Column, start: Column, pages: Column) -> Column:
    """The last page of a search; null where there is no end to it."""
    last = F.when(provider == "scholar", LAST_PAGE["scholar"]).when(provider == "justia", LAST_PAGE["justia"])
    return F.when(pages == -1, last).otherwise(start + pages - 1)


def search_errors(r: Column, jurisdiction: Column) -> Column:
    """Of a search: struct(search_term, provider, pages_to_search, resume_page, max_cases_to_download, runtime_limit_minutes,
    year_from, year_to). jurisdiction: its key in the catalogue, null if it has none."""
    pages, start = F.coalesce(r["pages_to_search"], F.lit(1)), F.coalesce(r["resume_page"], F.lit(1))
    most, minutes = F.coalesce(r["max_cases_to_download"], F.lit(DEFAULT_DOWNLOADS)), r["runtime_limit_minutes"]
    by, last = r["provider"], end_page(r["provider"], start, pages)
    beyond = lambda c: F.when(by == "scholar", c > LAST_PAGE["scholar"]).when(by == "justia", c > LAST_PAGE["justia"])
    dated = r["year_from"].isNotNull() | r["year_to"].isNotNull()
    return _errors(
        (_blank(r["search_term"]), "search_term"), (~F.coalesce(by.isin(*PROVIDERS), F.lit(False)), "provider"), (jurisdiction.isNull(), "jurisdiction"),
        ((pages != -1) & ~pages.between(1, MAX_PAGES), "pages_to_search"), (start < 1, "resume_page"), (beyond(start), "resume_page_beyond"), (beyond(last) & ~F.coalesce(beyond(start), F.lit(False)), "pages_beyond"),
        ((most != -1) & ~most.between(0, MAX_DOWNLOADS), "max_cases_to_download"), (~minutes.between(1, MAX_MINUTES), "runtime_limit_minutes"),
        (~r["year_from"].between(FIRST_YEAR, LAST_YEAR), "year_from"), (~r["year_to"].between(FIRST_YEAR, LAST_YEAR), "year_to"), (r["year_from"] > r["year_to"], "year_order"),
        ((by == "justia") & (jurisdiction != "all"), "justia_courts"), ((by == "justia") & dated, "justia_dates"),
    )


def parameter_errors(provider: Column, r: Column) -> Column:
    """Of a provider's search: struct(query, cites, courts, year_from, year_to, filed_after, filed_before, page)."""
    after, before = U.iso_date(r["filed_after"]), U.iso_date(r["filed_before"])
    low, high = scholar_years(r)
    dated = r["year_from"].isNotNull() | r["year_to"].isNotNull() | ~_blank(r["filed_after"]) | ~_blank(r["filed_before"])
    justia, scholar = provider == "justia", provider == "scholar"
    return _errors(
        (r["year_from"] > r["year_to"], "year_order"), (~_blank(r["filed_after"]) & after.isNull(), "filed_after"), (~_blank(r["filed_before"]) & before.isNull(), "filed_before"),
        (r["filed_after"] > r["filed_before"], "filed_order"), (F.coalesce(r["page"], F.lit(1)) < 1, "page"),
        (justia & _blank(r["query"]), "justia_query"), (justia & ~_blank(r["cites"]), "justia_cites"), (justia & ~_blank(r["courts"]), "justia_courts"), (justia & dated, "justia_dates"),
        (scholar & (F.date_format(after, "MM-dd") != "01-01"), "scholar_filed_after"), (scholar & (F.date_format(before, "MM-dd") != "12-31"), "scholar_filed_before"), (scholar & (low > high), "scholar_years"),
    )


def scholar_years(r: Column) -> tuple[Column, Column]:
    """The years that a search by years and dates leaves for a provider that knows years only."""
    return F.greatest(r["year_from"], F.year(U.iso_date(r["filed_after"]))), F.least(r["year_to"], F.year(U.iso_date(r["filed_before"])))


def courtlistener_dates(r: Column) -> tuple[Column, Column]:
    """The dates for a provider that knows dates only: given ones, else the years' first and last days."""
    day = lambda year, end: F.when(year.isNotNull(), F.concat(year.cast("string"), F.lit(end)))
    return F.coalesce(r["filed_after"], day(r["year_from"], "-01-01")), F.coalesce(r["filed_before"], day(r["year_to"], "-12-31"))


def preflight_errors(providers: tuple[str, ...], filters: Column) -> Column:
    """The errors of a collection's filters with any of its providers."""
    probe = F.struct(F.lit(None).cast("string").alias("query"), F.lit("1").alias("cites"), *(filters[f].alias(f) for f in ("courts", "year_from", "year_to", "filed_after", "filed_before")), F.lit(1).alias("page"))
    return F.array_distinct(F.flatten(F.array(*(parameter_errors(F.lit(p), probe) for p in providers))))


def limit_is_lower(requested: Column, saved: Column) -> Column:
    """Whether a limit is below a saved one; -1 is no limit."""
    return (requested != -1) & ((saved == -1) | (requested < saved))


def limit_is_higher(requested: Column, saved: Column) -> Column:
    return (saved != -1) & ((requested == -1) | (requested > saved))


FILTERS = ("courts", "year_from", "year_to", "filed_after", "filed_before")


def resume_errors(new: Column, old: Column) -> Column:
    """What a resumed collection may not change: struct(save_path, providers, max_pages, download_limit, and FILTERS). Null means not asked for."""
    changed = lambda f: new[f].isNotNull() & ~new[f].eqNullSafe(old[f])
    return _errors(
        (new["save_path"].isNotNull(), "save_path"), (changed("providers"), "providers"), (limit_is_lower(new["max_pages"], F.coalesce(old["max_pages"], F.lit(-1))), "max_pages"),
        (limit_is_lower(new["download_limit"], old["download_limit"]), "download_limit"), *((changed(f), f) for f in FILTERS),
    )


def collection_limits(action: Column, pages: Column, downloads: Column, saved_pages: Column, saved_downloads: Column) -> Column:
    """struct(max_pages, download_limit, errors). A new collection has limits of its own; a resumed one keeps what it had unless it asks for more."""
    fresh = action != "resume"
    most = F.coalesce(pages, F.when(fresh, F.lit(1)).otherwise(saved_pages))
    kept = F.coalesce(downloads, F.when(fresh, F.lit(DEFAULT_DOWNLOADS)).otherwise(saved_downloads))
    bad = lambda c, low, high: (c != -1) & ~c.between(low, high)
    errors = _errors((~action.isin(*ACTIONS), "action"), (bad(pages, 1, 2_147_483_647), "max_pages"), (bad(downloads, 0, MAX_COLLECTED), "download_limit"))
    return F.struct(most.alias("max_pages"), kept.alias("download_limit"), errors.alias("errors"))


def case_key_errors(key: Column) -> Column:
    return _errors((_blank(key), "required"), (~_blank(key) & ~key.rlike(U.CASE_KEY), "characters"))


def run_fingerprint(r: Column) -> Column:
    """What makes two searches the same: term, provider, jurisdiction and years."""
    return F.sha2(F.to_json(F.struct(r["jurisdiction"].alias("jurisdiction"), r["provider"].alias("provider"), r["search_term"].alias("searchTerm"), r["year_from"].alias("yearFrom"), r["year_to"].alias("yearTo"))), 256)


def navigation_session(r: Column) -> Column:
    """The name of the session in which a search's pages are turned: the same for the same search."""
    own = F.sha2(F.to_json(F.struct(r["jurisdiction"].alias("jurisdiction"), r["search_term"].alias("searchTerm"), r["year_from"].alias("yearFrom"), r["year_to"].alias("yearTo"))), 256)
    return F.concat_ws(":", F.lit("legal_search"), r["provider"], F.substring(own, 1, 16))


def check_errors(checks: Column, allowed: tuple[str, ...]) -> Column:
    """The checks of a verification that aren't known."""
    return F.array_except(checks, F.array(*map(F.lit, allowed)))


def case_count_errors(cases: Column, most: int = 20) -> Column:
    return _errors((~F.size(cases).between(1, most), "cases"))
