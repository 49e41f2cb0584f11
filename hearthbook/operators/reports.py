"""Counts, shares, pivots and rendered pages."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from hearthbook.functions.text import search_query
from hearthbook.operators.ordering import number_rows
from hearthbook.rulesets import entities as ent, ocr


def category_share(df: DataFrame, category: str = "category") -> DataFrame:
    """Rows per category and percent of all, one decimal."""
    counted = df.groupBy(category).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return counted.withColumn("percent", F.round(F.col("n") * 100 / total, 1))


def top_categories(df: DataFrame, category: str, k: int = 10) -> list[str]:
    """Most frequent categories; ``k`` names come to the driver to become pivot columns."""
    counted = df.groupBy(category).agg(F.count(F.lit(1)).alias("n"))
    return [r[0] for r in counted.orderBy(F.desc("n"), F.asc(category)).limit(k).collect()]


def month_pivot(df: DataFrame, month: str, category: str, top: int = 10, names: Sequence[str] | None = None) -> DataFrame:
    """One row per month: the top categories, Other and Total, counted in one conditional pass."""
    chosen = list(names) if names is not None else top_categories(df, category, top)
    cat = F.col(category)
    return df.groupBy(month).agg(
        *[F.count_if(cat == c).alias(c) for c in chosen],
        F.count_if(~cat.isin(chosen)).alias("Other"), F.count(F.lit(1)).alias("Total"))


def family_totals(df: DataFrame, category: str = "category", families: Mapping[str, str] = ocr.FAMILIES) -> DataFrame:
    """Totals per family and per member category."""
    lookup = F.create_map(*[F.lit(x) for kv in families.items() for x in kv])
    # texts are counted by category first: a filter on the family would classify each of them once more
    counted = df.groupBy(category).agg(F.count(F.lit(1)).alias("_n"))
    keyed = counted.withColumn("family", F.try_element_at(lookup, F.col(category)))
    return keyed.rollup("family", category).agg(F.sum("_n").alias("n")).filter(F.col("family").isNotNull())


def ticker_counts(df: DataFrame, text: str, k: int = 30) -> DataFrame:
    """Most mentioned tickers."""
    found = df.select(F.explode(F.regexp_extract_all(text, F.lit(ent.TICKER), F.lit(1))).alias("ticker"))
    return found.groupBy("ticker").agg(F.count(F.lit(1)).alias("mentions")).orderBy(
        F.desc("mentions"), F.asc("ticker")).limit(k)


def search_queries(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("query", F.coalesce(search_query(F.col(text)), F.lit("(could not extract)")))


def style_fingerprint(df: DataFrame, key: str, text: str) -> DataFrame:
    """Measures of writing per author or surface: means over whole texts, medians by percentile.

    Paragraph medians need every paragraph length; they are counted per length first, so the median
    is taken over a few thousand counted lengths.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.regexp_count(t, F.lit(r"[\p{L}\p{N}']+"))
    ends = F.greatest(F.regexp_count(t, F.lit(r"[.!?]+(?=\s|$)")), F.lit(1))
    marks = F.regexp_count(t, F.lit(r"[,;:()!?—-]"))
    capital = F.regexp_like(F.ltrim(t), F.lit(r"^\p{Lu}"))
    base = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("texts"),
        F.sum(words).alias("_w"), F.sum(ends).alias("_s"), F.sum(marks).alias("_m"), F.sum(F.length(t)).alias("_c"),
        F.count_if(capital).alias("_cap"))
    lengths = df.select(key, F.length(t).alias("v"), F.lit("chars").alias("what")).unionByName(
        df.select(key, F.explode(F.filter(
            F.transform(F.split(t, "\n+"), lambda p: F.regexp_count(p, F.lit(r"[\p{L}\p{N}']+"))), lambda n: n > 0)
        ).alias("v"), F.lit("paragraph").alias("what")))
    counted = lengths.groupBy(key, "what", "v").agg(F.count(F.lit(1)).alias("f"))
    medians = counted.groupBy(key).agg(
        F.percentile(F.when(F.col("what") == "chars", F.col("v")), 0.5, F.col("f")).alias("median_chars"),
        F.percentile(F.when(F.col("what") == "paragraph", F.col("v")), 0.5, F.col("f")).alias("median_paragraph_words"))
    return base.join(medians, key).select(
        key, "texts",
        F.round(F.col("_w") / F.col("_s"), 2).alias("words_per_sentence"),
        F.round(F.col("_m") * 100 / F.greatest(F.col("_c"), F.lit(1)), 3).alias("marks_per_100_chars"),
        F.round(F.col("_cap") / F.col("texts"), 3).alias("capital_start"),
        "median_chars", "median_paragraph_words")


# -- rendered pages -----------------------------------------------------------------------------


def render_pages(df: DataFrame, key: Sequence[str], order: Sequence[str], line: Column, slice_by: Column,
                 part_lines: int = 1000, sep: str = "\n") -> DataFrame:
    """Pages as numbered parts of at most ``part_lines`` lines in order; a page of any length is
    never gathered in one place. ``slice_by`` grows with the first order column."""
    rows = df.select(*key, *order, line.alias("_line"), slice_by.alias("_by"))
    placed = number_rows(rows, key, [F.col(o) for o in order], F.col("_by"), "_pos")
    parted = placed.withColumn("part", F.floor((F.col("_pos") - 1) / part_lines))
    return parted.groupBy(*key, "part").agg(
        F.count(F.lit(1)).alias("lines"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_line"))), lambda r: r["_line"]), sep).alias("page"))
