"""Extraction of the fourteen entity kinds from a text, as array columns.

The text is expected to be cleaned of screen furniture first (``text.clean_lines``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from hearthbook.functions.prefilter import contains_any, holds_any
from hearthbook.functions.text import all_matches, any_of, dedup_ci, matches, strip, unicode_words
from hearthbook.rulesets import entities as ent


def _capped(arr: Column, kind: str, caps: dict[str, int] | None) -> Column:
    return F.slice(arr, 1, caps[kind]) if caps and kind in caps else arr


def _head(lines: Column, n: int | None) -> Column:
    return lines if n is None else F.slice(lines, 1, n)


def _nonempty(arr: Column) -> Column:
    return F.filter(arr, lambda x: F.coalesce(x, F.lit("")) != "")


def _groups(text: Column, pattern: str, n: int) -> Column:
    """Every participating group of every match, in text order.

    The text is searched once and each match, by itself, read for its groups: for patterns that do not look behind
    or ahead of a match but for line starts and ends.
    """
    p = unicode_words(pattern)
    parts = F.transform(all_matches(text, pattern), lambda m: F.array(*[F.regexp_extract(m, p, g) for g in range(1, n + 1)]))
    return _nonempty(F.transform(F.flatten(parts), strip))


def category_has(category: Column | None, words: list[str]) -> Column:
    if category is None:
        return F.lit(False)
    return F.coalesce(contains_any(F.lower(category), list(words)), F.lit(False))


def extract_phones(text: Column) -> Column:
    """Numbers of 7-11 digits that are not engagement counts."""
    def keep(p: Column) -> Column:
        digits = F.length(F.regexp_replace(p, r"\D", ""))
        metric = F.concat(F.lit("(?i)" + ent.METRIC_WORDS + r"\s*\Q"), p, F.lit(r"\E"))
        return digits.between(7, 11) & ~F.regexp_like(text, metric)
    return F.filter(all_matches(text, ent.PHONE), keep)


def extract_emails(text: Column) -> Column:
    return dedup_ci(all_matches(text, ent.EMAIL))


def extract_urls(text: Column) -> Column:
    def keep(u: Column) -> Column:
        head = F.lower(F.substring_index(F.substring_index(u, "/", 1), "?", 1))
        return (F.length(u) >= 6) & ~head.isin(ent.URL_NOISE)
    return dedup_ci(F.filter(all_matches(text, ent.URL), keep))


def extract_handles(text: Column) -> Column:
    named = F.filter(all_matches(text, ent.HANDLE, 1), lambda h: ~F.lower(h).isin(ent.HANDLE_SKIP))
    return dedup_ci(F.transform(named, lambda h: F.concat(F.lit("@"), h)))


def extract_dates(text: Column) -> Column:
    return dedup_ci(all_matches(text, ent.DATE))


def extract_prices(text: Column) -> Column:
    return dedup_ci(all_matches(text, ent.PRICE))


def extract_addresses(text: Column) -> Column:
    return dedup_ci(all_matches(text, ent.ADDRESS))


def extract_tickers(text: Column) -> Column:
    return dedup_ci(F.transform(all_matches(text, ent.TICKER, 1), lambda t: F.concat(F.lit("$"), t)))


def extract_todos(text: Column, caps=ent.KIND_CAPS) -> Column:
    return _capped(dedup_ci(all_matches(text, ent.TODO)), "todos", caps)


def extract_quotes(text: Column, category: Column | None = None, caps=ent.KIND_CAPS) -> Column:
    """Quoted passages, and standalone lines of inspirational texts."""
    quoted = all_matches(text, ent.QUOTE, 1)
    lines = F.filter(
        F.transform(F.split(text, "\n"), strip),
        lambda x: (F.length(x) > 30) & (F.length(x) < 300) & ~matches(x, r"^[@\d<(]"),
    )
    with_lines = F.aggregate(
        lines, quoted,
        lambda acc, x: F.when(F.exists(acc, lambda q: F.contains(x, q)), acc).otherwise(
            F.concat(acc, F.array(x))),
    )
    inspiring = category_has(category, [ent.QUOTE_CATEGORY_WORD])
    return _capped(dedup_ci(F.when(inspiring, with_lines).otherwise(quoted)), "quotes", caps)


def extract_products(text: Column, caps=ent.KIND_CAPS) -> Column:
    # most texts hold no brand: looking for all as plain words is much cheaper than trying each at every place
    branded = holds_any(text, ent.PRODUCT_NAMES, fold=True)
    priced = F.when(F.contains(text, F.lit("$")), all_matches(text, "(?i)" + ent.PRODUCT_PRICED)).otherwise(F.array().cast("array<string>"))
    found = F.transform(F.when(branded, all_matches(text, ent.PRODUCT)).otherwise(priced), lambda p: strip(F.regexp_replace(strip(p), r"\s*\n\s*", " ")))
    kept = F.filter(found, lambda p: (F.length(p) > 3) & ~F.lower(p).isin(ent.PRODUCT_NOISE))
    return _capped(dedup_ci(kept), "products", caps)


def extract_services(text: Column, category: Column | None = None, caps=ent.KIND_CAPS, head_lines: int | None = 10) -> Column:
    """Named businesses and, where the category speaks of places, names that open one of the first ``head_lines`` lines (all if None)."""
    named = F.filter(
        _groups(text, ent.BUSINESS, 3),
        lambda s: (F.length(s) > 2) & ~F.lower(s).isin(ent.SERVICE_NOISE) & ~matches(s, r"^\d"),
    )
    head = F.transform(
        _head(F.split(text, "\n"), head_lines),
        lambda x: strip(F.regexp_extract(strip(x), ent.BUSINESS_LINE.replace(r"\w", r"\p{L}\p{N}_"), 1)),
    )
    venues = F.filter(head, lambda s: (F.length(s) > 3) & ~F.lower(s).isin(ent.SERVICE_LINE_NOISE))
    both = F.when(category_has(category, ent.SERVICE_CATEGORY_WORDS), F.concat(named, venues)).otherwise(named)
    return _capped(dedup_ci(both), "services", caps)


def extract_people(text: Column, caps=ent.KIND_CAPS) -> Column:
    """Named people and the first five handles."""
    named = F.filter(_groups(text, ent.PERSON, 5), lambda p: F.length(p) > 2)
    everyone = F.concat(named, F.slice(extract_handles(text), 1, 5))
    kept = F.filter(
        everyone,
        lambda p: ~F.substring_index(F.lower(p), " ", 1).isin(ent.NAME_NOISE) & (F.length(p) > 2)
        & ~matches(p, "^(?:" + any_of(ent.PROVIDER_HANDLES) + ")"),
    )
    return _capped(dedup_ci(kept), "people", caps)


def extract_contacts(text: Column, category: Column | None = None, head_lines: int | None = 3) -> Column:
    """Name of the other side at the head of a messaging screen: the first ``head_lines`` lines, all if None."""
    head = _head(F.split(strip(text), "\n"), head_lines)
    names = F.filter(
        F.transform(head, lambda x: F.regexp_extract(x, ent.CONTACT_NAME, 1)),
        lambda n: (F.length(n) > 3) & ~F.lower(n).isin(ent.NAME_NOISE),
    )
    empty = F.array().cast("array<string>")
    return F.when(category_has(category, ent.MESSAGE_CATEGORY_WORDS), F.slice(names, 1, 1)).otherwise(empty)


def extractors(text: Column, category: Column | None = None, caps=ent.KIND_CAPS,
               kinds: Sequence[str] = tuple(ent.KINDS)) -> dict[str, Column]:
    """Array column of each wanted kind."""
    makers = {
        "phones": lambda: extract_phones(text), "emails": lambda: extract_emails(text),
        "urls": lambda: extract_urls(text), "handles": lambda: extract_handles(text),
        "dates_mentioned": lambda: extract_dates(text), "prices": lambda: extract_prices(text),
        "addresses": lambda: extract_addresses(text), "tickers": lambda: extract_tickers(text),
        "todos": lambda: extract_todos(text, caps), "quotes": lambda: extract_quotes(text, category, caps),
        "products": lambda: extract_products(text, caps),
        "services": lambda: extract_services(text, category, caps),
        "people": lambda: extract_people(text, caps), "contacts": lambda: extract_contacts(text, category),
    }
    return {k: makers[k]() for k in kinds}
