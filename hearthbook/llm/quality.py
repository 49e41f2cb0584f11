"""Quality rules as a short-circuit cascade in native columns.

Every rule says when a document fails. On a small sample each rule is timed and its rejections are
counted; rules then stand in the order of rejections per second, and a document leaves the cascade
at the first rule that it fails, so costly rules see only what cheap ones let through. The order
changes the work, never the verdict: a document is kept if no rule fails it.

Null and blank texts have no words and fail the word count. Any other columns pass through.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from hearthbook.llm.common import GAP, WORD, let, word_list
from hearthbook.session import materialise

NGRAM = 5
RUN = "struct<x:bigint,i:int>"


class Rule(NamedTuple):
    name: str
    fails: Callable[[Column], Column]


def repeated_words(words: Column) -> Column:
    """Words that lie in a five-word window found twice or more in the text.

    Windows are hashed to 64 bits; only a text whose hashes are not all different is looked at
    further: hashes are sorted with their places, places of equal hashes kept, and what each
    window covers beyond the one before it is added up.
    """
    def windows(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - NGRAM)
        return F.when(F.size(w) < NGRAM, F.array().cast("array<bigint>")).otherwise(
            F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(NGRAM)])))

    def twins(runs: Column) -> Column:
        none = F.array(F.lit(None).cast(RUN))
        before = F.concat(none, F.slice(runs, 1, F.size(runs) - 1))
        after = F.concat(F.slice(runs, 2, F.size(runs) - 1), none)
        near = F.filter(F.arrays_zip(runs.alias("e"), before.alias("b"), after.alias("a")),
                        lambda z: z["e"]["x"].eqNullSafe(z["b"]["x"]) | z["e"]["x"].eqNullSafe(z["a"]["x"]))
        return F.sort_array(F.transform(near, lambda z: z["e"]["i"]))

    def covered(h: Column) -> Column:
        runs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        return F.aggregate(
            let(runs, twins), F.struct(F.lit(0).alias("n"), F.lit(-NGRAM).alias("last")),
            lambda s, p: F.struct((s["n"] + F.least(F.lit(NGRAM), p - s["last"])).alias("n"), p.alias("last")))["n"]

    return let(let(words, windows), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
        covered(h))).cast("long")


def features(text: str = "text") -> dict[str, Column]:
    """The measured columns of a text; each may be used alone."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    return {
        "word_chars": F.length(F.regexp_replace(t, GAP + "+", "")).cast("long"),
        "n_symbols": F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_upper": F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    }


def measured(docs: DataFrame, text: str = "text", prefix: str = "_q_") -> DataFrame:
    """``docs`` with every feature in a column of its own, named ``prefix`` + feature."""
    docs = docs.withColumn(f"{prefix}words", word_list(F.col(text)))
    words = F.col(f"{prefix}words")
    own = features(text) | {"n_words": F.size(words).cast("long"), "n_repeat_words": repeated_words(words),
                            "word_chars": F.length(F.array_join(words, "")).cast("long")}
    return docs.withColumns({prefix + n: c for n, c in own.items()}).drop(f"{prefix}words")


# Verdicts over the features; ``f(name)`` gives a feature as a column.
RULES = [
    Rule("few_words", lambda f: f("n_words") < 10),
    Rule("repeated_words", lambda f: 100 * f("n_repeat_words") > 20 * f("n_words")),
    Rule("symbols", lambda f: 10 * f("n_symbols") > f("n_words")),
    Rule("shouting", lambda f: 2 * f("n_upper") > f("word_chars")),
    Rule("word_length", lambda f: (f("word_chars") < 2 * f("n_words")) | (f("word_chars") > 15 * f("n_words"))),
    Rule("repeated_lines", lambda f: 10 * f("n_dup_lines") > 3 * f("n_lines")),
]


def from_text(text: str = "text") -> Callable[[str], Column]:
    """A feature computed from the text where it is asked for, and nowhere else."""
    own = features(text)
    words = word_list(F.col(text))
    own |= {"n_words": F.size(words).cast("long"), "n_repeat_words": repeated_words(words)}
    return lambda name: own[name]


def order_rules(docs: DataFrame, rules: list[Rule] = RULES, text: str = "text", share: float = 0.02,
                rows: int = 500) -> list[tuple[Rule, float, float]]:
    """Rules by rejections per second on a sample, best first, with seconds and rejected share.

    The sample (a ``share`` of the rows, ``rows`` at most) steers the order alone.
    """
    feature = from_text(text)
    sample = materialise(docs.select(text).sample(share, seed=11).limit(rows), "sample")
    found = []
    for rule in rules:
        seen = sample.agg(F.avg(F.coalesce(rule.fails(feature), F.lit(False)).cast("double")).alias("share"))
        seen.collect()
        start = time.perf_counter()
        rejected = seen.first()["share"] or 0.0
        found.append((rule, time.perf_counter() - start, rejected))
    return sorted(found, key=lambda x: -(x[2] + 1e-6) / x[1])


def cascade(feature: Callable[[str], Column], rules: list[Rule]) -> Column:
    """True if no rule fails the document; rules behind the first failing one are not evaluated."""
    verdict = F.lit(True)
    for rule in reversed(rules):
        verdict = F.when(rule.fails(feature), F.lit(False)).otherwise(verdict)
    return verdict


def quality_filter(docs: DataFrame, rules: list[Rule] = RULES, text: str = "text") -> DataFrame:
    """The documents that pass every rule, with their columns as they came."""
    ordered = [rule for rule, _, _ in order_rules(docs, rules, text)]
    return docs.filter(cascade(from_text(text), ordered))
