"""Column functions that score contacts, entities, ideas and candidates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from hearthbook.functions.dates import gap_days
from hearthbook.functions.text import matches
from hearthbook.rulesets import chat, files, mail


def relationship_strength(n: Column, last: Column, from_n: Column, to_n: Column, as_of: str) -> Column:
    """0-100 from volume (15), recency over two years (40) and reciprocity (45)."""
    volume = F.when(n > 0, F.least(F.lit(15.0), F.log2(n) * 15.0 / F.log2(F.lit(500.0)))).otherwise(0.0)
    share = F.lit(1.0) - gap_days(last, as_of) / F.lit(730.0)
    recency = F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), share)) * 40.0, F.lit(0.0))
    two_way = F.least(from_n, to_n) / F.greatest(from_n, to_n) * 45.0
    reciprocity = (
        F.when((from_n > 0) & (to_n > 0), two_way)
        .when((from_n > 0) | (to_n > 0), F.lit(10.0))
        .otherwise(F.lit(0.0))
    )
    total = F.least(F.lit(100.0), F.greatest(F.lit(0.0), volume + recency + reciprocity))
    return F.bround(total, 0).cast("int")


def drip_member(strength: Column, gap: Column) -> Column:
    """Campaign subset: strong enough and in touch within two years."""
    return (strength >= 25) & gap.isNotNull() & (gap < 730)


def is_relevant(enriched: Column, total: Column, kind: Column, notable: Column, page: Column) -> Column:
    """Keep for the cast list."""
    reason = (
        F.coalesce(kind.isin(mail.CAST_TYPES), F.lit(False))
        | (total >= 50)
        | (F.coalesce(notable, F.lit("")) != "")
        | page.isNotNull()
        | (F.coalesce(kind == "contractor", F.lit(False)) & (total >= 20))
    )
    return (enriched | (total >= 50)) & reason


def page_action(status: Column, enriched_ok: Column, total: Column, strength: Column, kind: Column,
                min_strength: int = 50) -> Column:
    """``update`` an existing page, ``create`` one, or ``none``."""
    worth = (
        (strength >= min_strength) | (total >= 30)
        | F.coalesce(kind.isin(mail.PAGE_TYPES), F.lit(False))
    )
    return (
        F.when(status == "confirmed", "update")
        .when(enriched_ok & (total >= 10) & worth, "create")
        .otherwise("none")
    )


def idea_score(heat: Column, edge: Column, legend: Column, ship: Column, yield_: Column, drag: Column) -> Column:
    return heat + edge * 2 + legend + ship + yield_ - drag


def idea_stage(score: Column) -> Column:
    return (
        F.when(score >= 22, "Now").when(score >= 17, "Queue").when(score >= 12, "Incubate")
        .when(score >= 7, "Back burner").otherwise("Reframe")
    )


# -- social contact score -----------------------------------------------------------------------


def word_mask(text: Column, words: list[str]) -> Column:
    """Bit ``i`` is set when the text holds word ``i``. Masks of a group combine with ``bit_or``."""
    if len(words) > 63:
        raise ValueError("a mask holds at most 63 words; split the list")
    bits = [F.when(F.contains(text, F.lit(w)), F.lit(1 << i)).otherwise(F.lit(0)) for i, w in enumerate(words)]
    total = F.lit(0).cast("bigint")
    for b in bits:
        total = total + b.cast("bigint")
    return total


def mask_has(mask: Column, words: list[str], wanted: list[str]) -> Column:
    bits = sum(1 << words.index(w) for w in wanted)
    return mask.bitwiseAND(F.lit(bits).cast("bigint")) != 0


def depth_points(n: Column) -> Column:
    return F.when(n >= 30, 20).when(n >= 20, 15).when(n >= 10, 10).when(n >= 5, 5).otherwise(2)


def reciprocity_points(own: Column, other: Column) -> Column:
    ratio = F.least(own, other) / F.greatest(own, other, F.lit(1))
    return F.floor(ratio * 15).cast("int")


def hit_points(n: Column, each: int, most: int) -> Column:
    return F.least(n * each, F.lit(most)).cast("int")


def recency_points(last_year: Column, points: dict[int, int] = chat.RECENCY_POINTS) -> Column:
    out = F.when(F.lit(False), F.lit(1))
    for year, value in points.items():
        out = out.when(last_year == year, value)
    return out.otherwise(1)


def substance_points(mean_chars: Column) -> Column:
    return (
        F.when(mean_chars > 100, 10).when(mean_chars > 50, 6).when(mean_chars > 20, 3).otherwise(0)
    )


def contact_tags(professional: Column, warmth: Column, followup: Column, mask: Column, words: list[str],
                 groups: dict[str, list[str]] = chat.TAG_WORDS) -> Column:
    """Relationship tags from the sub-scores and keyword groups; ``General`` when none applies."""
    tags = [
        F.when(professional >= 10, "Professional"),
        F.when(warmth >= 6, "Personal"),
        F.when(followup >= 6, "Reconnect"),
    ]
    tags += [F.when(mask_has(mask, words, w), F.lit(name)) for name, w in groups.items()]
    found = F.filter(F.array(*tags), lambda t: t.isNotNull())
    return F.when(F.size(found) == 0, F.array(F.lit("General"))).otherwise(found)


def snippet(other: Column, own: Column, max_len: int = 300) -> Column:
    """Longest short message of the other side (else of the owner) from arrays in message order."""
    def longest(arr: Column) -> Column:
        short = F.filter(arr, lambda m: F.length(m) < max_len)
        ranked = F.transform(short, lambda m, i: F.struct((-F.length(m)).alias("n"), i.alias("i"), m.alias("m")))
        return F.array_min(ranked)["m"]
    return cut_snippet(F.coalesce(longest(other), longest(own), F.lit("")))


def cut_snippet(best: Column) -> Column:
    cut = F.when(F.length(best) > 150, F.concat(F.substring(best, 1, 147), F.lit("..."))).otherwise(best)
    return F.translate(cut, "\n", " ")


# -- entity score -------------------------------------------------------------------------------


def entity_recency(last_month: Column, as_of: str) -> Column:
    """0-5, one point less per quarter between the month and ``as_of``."""
    months = F.datediff(F.lit(as_of).cast("date"), last_month) / 30
    points = F.greatest(F.lit(0.0), F.least(F.lit(5.0), F.lit(5.0) - months / 3))
    return F.coalesce(F.floor(points).cast("int"), F.lit(0))


def entity_repetition(n: Column) -> Column:
    return F.when(n >= 10, 5).when(n >= 5, 4).when(n >= 3, 3).when(n >= 2, 2).otherwise(1)


def entity_contactability(emails: Column, phones: Column, handles: Column, urls: Column) -> Column:
    """Points for each kind of contact data that is present (boolean columns)."""
    def one(c: Column, value: int) -> Column:
        return F.when(c, value).otherwise(0)
    return F.least(F.lit(5), one(emails, 2) + one(phones, 2) + one(handles, 1) + one(urls, 1))


def entity_relevance(relevant_categories: Column, n: Column) -> Column:
    return F.least(F.lit(5), relevant_categories * 2 + F.when(n > 1, 1).otherwise(0)).cast("int")


def entity_confidence(n: Column, reachable: Column, months: Column) -> Column:
    raw = (
        F.lit(3) + F.when(n >= 3, 1).otherwise(0) + F.when(reachable, 1).otherwise(0)
        - F.when((months == 1) & (n == 1), 1).otherwise(0)
    )
    return F.greatest(F.lit(1), F.least(F.lit(5), raw))


def entity_tier(total: Column) -> Column:
    return (
        F.when(total >= 20, "20-25 Immediate").when(total >= 15, "15-19 Research")
        .when(total >= 10, "10-14 Archive").otherwise("0-9 Ignore")
    )




# -- picking candidates -------------------------------------------------------------------------


def stem_of(name: Column) -> Column:
    return F.when(matches(name, r"^.+\.[^.]*$"), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)


def extension_of(name: Column) -> Column:
    return F.when(matches(name, r"^.+\.[^.]*$"), F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))).otherwise("")


def work_title(folder: Column) -> Column:
    return F.regexp_replace(folder, r"^\d{4}\s*-\s*(?=.)", "")


def hero_score(name: Column, title: Column, size: Column) -> Column:
    """How likely a file is the main image of a work, by its name and size."""
    lower = F.lower(name)
    base = stem_of(name)
    base_lower = F.lower(base)
    ext = extension_of(name)
    squeezed = F.regexp_replace(base_lower, "[^a-z0-9]+", "")
    title_key = F.regexp_replace(F.lower(title), "[^a-z0-9]+", "")
    tokens = F.filter(F.split(F.lower(title), r"[\s\-_]+"), lambda t: F.length(t) >= 3)
    matched = F.size(F.filter(tokens, lambda t: F.contains(squeezed, F.regexp_replace(t, "[^a-z0-9]+", ""))))
    title_points = (
        F.when(F.coalesce(title, F.lit("")) == "", 0)
        .when((title_key != "") & F.contains(squeezed, title_key), 5)
        .when((F.size(tokens) > 0) & (matched / F.greatest(F.size(tokens), F.lit(1)) >= 0.5), 3)
        .when(matched >= 2, 2)
        .otherwise(0)
    )

    def when(cond: Column, points: int) -> Column:
        return F.when(cond, points).otherwise(0)

    described = matches(base_lower, r"^[a-z][a-z0-9\-_\s]*[a-z0-9]$") & ~matches(base_lower, "^img")
    length_points = F.when(F.length(base) > 12, 2).when(F.length(base) <= 6, -1).otherwise(0)
    megabytes = F.least(F.floor(size / (1024 * 1024)), F.lit(4))
    return (
        title_points
        + when(F.contains(base_lower, F.lit("front")), 3)
        + when(described, 2)
        + when(ext.isin(files.PICK_PLUS_EXTENSIONS), 2)
        + when(ext.isin(files.PICK_MINUS_EXTENSIONS), -1)
        + length_points
        + megabytes
        + when(matches(base_lower, r"^(img[_ ]|os6a|dsc|p\d{7})"), -3)
        + when(matches(base_lower, "^(screen shot|screenshot)"), -5)
        + when(F.contains(lower, F.lit("back")), -2)
        + when(matches(base, r"__\d+$"), -1)
        + when(F.contains(lower, F.lit(".compressed")) | F.contains(lower, F.lit("thumbnail")), -2)
        + when(matches(base, r"^\d+$"), -5)
    ).cast("int")


def path_bias(folder: Column, table: dict[str, int] = files.FOLDER_BIAS) -> Column:
    """Sum of the bias of every folder on the way to a file."""
    lookup = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    parts = F.transform(F.split(F.lower(folder), "/"), lambda p: F.coalesce(F.try_element_at(lookup, p), F.lit(0)))
    return F.aggregate(parts, F.lit(0), lambda acc, x: acc + x)


def hero_candidates_filter(name: Column, folder: Column) -> Column:
    """Image files that are not helper files and not in underscore folders."""
    return (
        extension_of(name).isin(files.PICK_IMAGE_EXTENSIONS)
        & ~matches(name, "^(_meta|_series)")
        & ~matches(folder, "(^|/)_")
    )


