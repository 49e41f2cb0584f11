"""One rule engine for texts: first hit, several labels, weighted scores, keyword scores.

Rules become column expressions, so a table is classified in one pass inside the scan stage,
without a join between texts and rules.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from hearthbook.functions.prefilter import PatternIndex, contains_any, held
from hearthbook.functions.text import let, matches, occurs, strip, unicode_words
from hearthbook.rulesets import chat, files, ocr, timeline


def first_hit(text: Column, rules: Sequence[tuple[str, str]], default: Column | None = None) -> Column:
    """Label of the first rule whose pattern occurs in the lower-cased text, else ``default``."""
    def chain(low: Column) -> Column:
        out = None
        for label, pattern in rules:
            cond = occurs(low, pattern)
            out = F.when(cond, label) if out is None else out.when(cond, label)
        return out.otherwise(default if default is not None else F.lit(None).cast("string"))

    return let(F.lower(text), chain)


def event_type(subject: Column, body: Column, body_chars: int | None = None) -> Column:
    """Kind of event a thread speaks of, by subject and body, or the first ``body_chars`` of it."""
    body = F.coalesce(body, F.lit(""))
    read = body if body_chars is None else F.substring(body, 1, body_chars)
    return first_hit(F.concat_ws(" ", F.coalesce(subject, F.lit("")), read), timeline.EVENT_RULES)


def narrative_role(summary: Column, notable: Column, total: Column, kind: Column) -> Column:
    """Role in the story: by keyword groups, then by volume, then by relationship type."""
    text = F.lower(F.concat_ws(" ", F.coalesce(summary, F.lit("")), F.coalesce(notable, F.lit(""))))
    out = None
    for label, words in timeline.NARRATIVE_RULES:
        cond = contains_any(text, list(words))
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return (
        out.when(total >= 100, "core collaborator")
        .when(kind.isin("collaborator", "contractor"), "collaborator")
        .when(kind == "peer", "peer/witness")
        .otherwise("supporting")
    )


def multi_label(text: Column, rules: Mapping[str, Sequence[str]], default: str = "uncategorized") -> Column:
    """Every label with a keyword in the lower-cased text, in rule order."""
    labels = let(F.lower(F.coalesce(text, F.lit(""))), lambda low: F.array(
        *[F.when(contains_any(low, list(words)), F.lit(label)) for label, words in rules.items()]))
    found = F.filter(labels, lambda x: x.isNotNull())
    return F.when(F.size(found) == 0, F.array(F.lit(default))).otherwise(found)


def skip_conversation(title: Column, patterns: Sequence[str] = tuple(chat.SKIP_PATTERNS)) -> Column:
    """True for throw-away titles."""
    return matches(F.lower(F.coalesce(title, F.lit(""))), "|".join(f"(?:{p})" for p in patterns))


def theme_tags(text: Column, era: Column, rules=timeline.THEME_RULES) -> Column:
    """Sorted tags: era, ``press`` and themes; ``profile`` when no theme applies."""
    found = let(F.lower(text), lambda low: F.array(
        *[F.when(occurs(low, p), F.array(*[F.lit(t) for t in tags])) for p, tags in rules]))
    themes = F.flatten(F.filter(found, lambda x: x.isNotNull()))
    themed = F.when(F.size(themes) == 0, F.array(F.lit("profile"))).otherwise(themes)
    return F.array_sort(F.array_distinct(F.concat(F.array(era, F.lit("press")), themed)))


# -- weighted classes ---------------------------------------------------------------------------

Weighted = Mapping[str, Sequence[tuple[int, str]]]


def flat_rules(rules: Mapping[str, Sequence[str]], weight: int = 1) -> dict[str, list[tuple[int, str]]]:
    """Rules without weights as weighted rules."""
    return {k: [(weight, p) for p in ps] for k, ps in rules.items()}


def grouped_rules(rules: Mapping[str, tuple[int, Sequence[str]]]) -> dict[str, list[tuple[int, str]]]:
    """Rules with one weight per category as weighted rules."""
    return {k: [(w, p) for p in ps] for k, (w, ps) in rules.items()}


class Reading(NamedTuple):
    """A text as written and in lower case, and the numbers of the patterns that may match either."""

    raw: Column
    low: Column
    in_raw: Column
    in_low: Column


def pattern_hits(t: Reading, index: PatternIndex, weight: int, pattern: str, as_written: int | None) -> Column:
    """Hits of one rule: strong signals look at the text as written first, the rest at lower case."""
    def counted(text: Column, own: Column) -> Column:
        need, found = index.need(pattern, own, t.in_low), F.regexp_count(text, F.lit(unicode_words(pattern)))
        return found if need is None else F.when(need, found).otherwise(0)

    if as_written is None or weight < as_written:
        return counted(t.low, t.in_low)
    return let(counted(t.raw, t.in_raw), lambda exact: F.when(exact > 0, exact).otherwise(counted(t.low, t.in_low)))


def category_scores(t: Reading, index: PatternIndex, rules: Weighted, as_written: int | None = None) -> list[tuple[str, Column]]:
    out = []
    for label, patterns in rules.items():
        total = None
        for weight, pattern in patterns:
            term = pattern_hits(t, index, weight, pattern, as_written) * weight
            total = term if total is None else total + term
        out.append((label, total))
    return out


def weighted_class(
    df: DataFrame,
    text: str,
    rules: Weighted,
    default: str,
    min_len: int,
    too_short: str | None = None,
    fallback: Weighted | None = None,
    fallback_below: int = 3,
    as_written: int | None = None,
) -> DataFrame:
    """Add ``category``, ``score`` and ``runners_up`` (top three scores by category).

    The highest sum of weight times hits wins; ties go to the earlier category.
    """
    raw = F.coalesce(F.col(text), F.lit(""))
    staged = df.withColumn("_raw", raw).withColumn("_low", F.lower(raw))
    # one pass over either form of the text tells which rules can match at all
    index = PatternIndex([p for some in (rules, fallback or {}) for ps in some.values() for _, p in ps])
    in_raw = index.numbers(F.col("_raw")) if as_written is not None else F.array().cast("array<string>")
    staged = staged.withColumn("_found", F.struct(in_raw.alias("raw"), index.numbers(F.col("_low")).alias("low")))
    both = F.struct(F.col("_raw").alias("raw"), F.col("_low").alias("low"), F.col("_found").alias("found"))
    reading = lambda t: Reading(t["raw"], t["low"], t["found"]["raw"], t["found"]["low"])
    scored = staged.withColumn("_scores", let(both, lambda t: F.array(
        *[s for _, s in category_scores(reading(t), index, rules, as_written)])))
    names = list(rules)
    scores = F.col("_scores")
    if fallback:
        weak = F.array_max(scores) < fallback_below
        extra_names = [n for n in fallback if n not in names]
        names = names + extra_names

        def more(t: Column) -> Column:
            extra = dict(category_scores(reading(t), index, fallback))
            return F.array(*[extra.get(n, F.lit(0)) for n in names])

        added = let(both, more)
        padded = F.concat(scores, F.array_repeat(F.lit(0), len(extra_names))) if extra_names else scores
        scores = F.when(weak, F.zip_with(padded, added, lambda a, b: a + b)).otherwise(padded)
    labels = F.array(*[F.lit(n) for n in names])
    ranked = F.slice(F.array_sort(F.filter(
        F.transform(scores, lambda s, i: F.struct((-s).alias("neg"), i.alias("at"))), lambda x: x["neg"] < 0)), 1, 3)
    out = scored.withColumn("_top", ranked)
    short = F.length(strip(F.col("_raw"))) < min_len
    lead = F.get("_top", F.lit(0))
    named = F.transform("_top", lambda x: F.struct(F.get(labels, x["at"]).alias("category"), (-x["neg"]).alias("score")))
    empty = F.slice(named, 1, 0)
    return out.select(
        *df.columns,
        F.when(short, too_short or default).when(F.size("_top") == 0, default)
        .otherwise(F.get(labels, lead["at"])).alias("category"),
        F.when(short, 0).otherwise(F.coalesce(-lead["neg"], F.lit(0))).alias("score"),
        F.when(short, empty).otherwise(named).alias("runners_up"),
    )


def coarse_class(df: DataFrame, text: str) -> DataFrame:
    return weighted_class(df, text, flat_rules(ocr.COARSE_RULES), "Other", 10)


def refined_class(df: DataFrame, text: str) -> DataFrame:
    return weighted_class(df, text, grouped_rules(ocr.REFINED_RULES), "Other", 10)


def detailed_class(df: DataFrame, text: str) -> DataFrame:
    return weighted_class(df, text, ocr.DETAILED_RULES, "Uncategorized", 5, "Unreadable",
                          ocr.FALLBACK_RULES, as_written=ocr.AS_WRITTEN_WEIGHT)


def keyword_class(
    df: DataFrame, text: Column, default: Column, rules=files.DOCUMENT_CATEGORIES, min_score: float = 2.0
) -> DataFrame:
    """Add ``category`` and ``score``: distinct keywords found times the category weight."""
    every = list(dict.fromkeys(w for _, words in rules.values() for w in words))
    ranked = F.array(*[
        F.struct(
            (-F.size(F.array_intersect(F.col("_held"), F.array(*[F.lit(str(every.index(w))) for w in dict.fromkeys(words)]))) * F.lit(float(weight))).alias("neg"),
            F.lit(i).alias("at"), F.lit(label).alias("label"))
        for i, (label, (weight, words)) in enumerate(rules.items())
    ])
    best = df.withColumn("_held", held(F.lower(F.coalesce(text, F.lit(""))), [[w] for w in every])).withColumn("_best", F.array_min(ranked))
    score = -F.col("_best.neg")
    return best.withColumn("score", score).withColumn(
        "category", F.when(F.col("score") >= min_score, F.col("_best.label")).otherwise(default)
    ).drop("_best", "_held")
