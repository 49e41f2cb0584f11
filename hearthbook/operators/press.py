"""Press links, articles and the processing log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hearthbook.functions import dates as fd, text as ft
from hearthbook.functions.media import article_status
from hearthbook.operators.classify import theme_tags
from hearthbook.operators.linkage import display_name, match_articles
from hearthbook.operators.ordering import carry_forward, dedup_first
from hearthbook.rulesets import files as fr


def extract_press_links(elements: DataFrame, own_domain: str, page: str = "page_id", pos: str = "pos") -> DataFrame:
    """Outbound links with the year of the heading above them, first occurrence of each address.

    ``elements``: page, pos, tag, text, href, context - the output of ``sources.press.page_elements``.
    """
    year = F.when(ft.matches(F.col("text"), r"^(20\d{2}|19\d{2})$"), F.col("text"))
    marked = elements.withColumn("year", year)
    carried = carry_forward(marked, "year", [F.col(pos)], [page], F.shiftright(F.col(pos).cast("bigint"), 12))
    host = ft.link_host(F.col("href"))
    links = carried.filter(
        (F.col("tag") == "a") & F.startswith("href", F.lit("http")) & ~year_only(F.col("text"))
        & ~F.contains(F.coalesce(host, F.lit("")), F.lit(own_domain)))
    lookup = F.create_map(*[F.lit(x) for kv in fr.OUTLET_SLUGS.items() for x in kv])
    full = links.select(
        page, pos, F.col("href").alias("url"), F.col("text").alias("link_text"), "context",
        F.coalesce("year", ft.find_year(F.col("text"), F.coalesce("context", F.lit("")))).alias("year"),
        F.coalesce(F.try_element_at(lookup, host), ft.slugify(host)).alias("outlet"),
        ft.is_video_url(F.col("href")).alias("is_video"))
    return dedup_first(full, ["url"], [F.asc(page), F.asc(pos)])


def year_only(text: Column) -> Column:
    return ft.matches(F.coalesce(text, F.lit("")), r"^(20\d{2}|19\d{2})$")


def kept_articles(articles: DataFrame, body: str, min_chars: int) -> DataFrame:
    """Articles with enough text that are no error pages."""
    return articles.filter((F.length(body) >= min_chars) & ~ft.is_error_page(F.coalesce("title", F.lit(""))))


def tag_articles(articles: DataFrame, text: str, year: str) -> DataFrame:
    """Add era and theme tags."""
    era = fd.era_tag(F.col(year).try_cast("int"))
    return articles.withColumn("tags", theme_tags(F.col(text), era))


def article_file(year: Column, publisher: Column, headline: Column) -> Column:
    return F.concat(year.cast("string"), F.lit(" - Headline - "), publisher, F.lit(" - "), ft.headline_name(headline), F.lit(".md"))


def article_note(url: Column, author: Column, publisher: Column, date: Column, tags: Column, body: Column) -> Column:
    """Rendered article note."""
    known = F.when(F.coalesce(author, F.lit("")) == "", "Unknown").otherwise(author)
    return F.concat_ws(
        "\n", url, F.lit(""), F.concat(F.lit("**Author:** "), known), F.concat(F.lit("**Publisher:** "), publisher),
        F.concat(F.lit("**Date:** "), F.coalesce(fd.article_date(date), F.lit(""))), F.lit(""),
        F.array_join(F.transform(tags, lambda t: F.concat(F.lit("#"), t)), " "), F.lit(""), body)


def add_tags(existing: Column, tags: Column) -> Column:
    """Existing note with a tag line after its date line; notes that carry tags stay."""
    line = F.array_join(F.transform(tags, lambda t: F.concat(F.lit("#"), t)), " ")
    lines = F.split(existing, "\n")
    at = F.array_position(F.transform(lines, lambda x: F.startswith(x, F.lit("**Date:**"))), True)
    added = F.concat(F.slice(lines, 1, at.cast("int")), F.array(F.lit(""), line),
                     F.slice(lines, (at + 1).cast("int"), F.size(lines)))
    has_tags = ft.matches(existing, r"#[\p{L}\p{N}_]+")
    return F.when(~has_tags & (at > 0), F.array_join(added, "\n")).otherwise(existing)


def article_page(title: Column, author: Column, date: Column, site: Column, body_html: Column, url: Column) -> Column:
    """Clean article page."""
    by = F.nullif(F.coalesce(author, F.lit("")), F.lit(""))
    when = F.nullif(F.coalesce(date, F.lit("")), F.lit(""))
    byline = F.concat_ws(" · ", F.concat(F.lit("By "), by), when)
    return F.concat(
        F.lit('<!DOCTYPE html>\n<html lang="en">\n<head><meta charset="UTF-8"><title>'), F.coalesce(title, F.lit("Article")),
        F.lit('</title></head>\n<body>\n<div class="publication-name">'), F.coalesce(site, F.lit("")),
        F.lit("</div>\n<h1>"), F.coalesce(title, F.lit("Article")), F.lit('</h1>\n<div class="byline">'), byline,
        F.lit('</div>\n<div class="article-body">\n'), F.coalesce(body_html, F.lit("")),
        F.lit('\n</div>\n<div class="original-link">Originally published by <a href="'), url, F.lit('">'),
        F.coalesce(site, F.lit("")), F.lit("</a></div>\n</body>\n</html>"))


def paragraphs_html(text: Column) -> Column:
    """Plain text as headings and paragraphs."""
    return F.array_join(F.transform(ft.paragraphs(text), lambda p: F.when(
        p["is_heading"], F.concat(F.lit("      <h3>"), p["text"], F.lit("</h3>"))).otherwise(
        F.concat(F.lit("      <p>"), p["text"], F.lit("</p>")))), "\n")


def integrate_articles(articles: DataFrame, notes: DataFrame) -> DataFrame:
    """Action per article: ``create`` a note, ``update`` tags of the match, or ``skip``.

    ``articles``: article_id, headline, publisher, year, tags, note. ``notes``: file, content.
    """
    matched = articles.join(match_articles(articles, notes).withColumnRenamed("file", "_match"), "article_id", "left")
    named = matched.withColumn("file", F.coalesce(
        "_match", article_file(F.col("year"), F.col("publisher"), F.col("headline"))))
    joined = named.join(notes.select("file", F.col("content").alias("_content")), "file", "left")
    updated = add_tags(F.col("_content"), F.col("tags"))
    action = (
        F.when(F.col("_content").isNull(), "create")
        .when(F.col("_match").isNotNull() & (updated != F.col("_content")), "update").otherwise("skip"))
    return joined.withColumn("action", action).withColumn(
        "content", F.when(F.col("action") == "create", F.col("note")).when(F.col("action") == "update", updated)
    ).drop("_match", "_content")


def processing_status(results: DataFrame) -> DataFrame:
    return results.withColumn("status", article_status(F.col("is_video"), F.col("has_screenshot"), F.col("has_html")))


def upsert_log(log: DataFrame, updates: DataFrame) -> DataFrame:
    """New log: an unfinished row of the same year and outlet is replaced, other updates are added."""
    plain = F.regexp_replace("outlet", r"-[2-6]$", "")
    fresh = dedup_first(updates, ["year", "outlet"], [F.asc("headline")])
    keys = fresh.select("year", plain.alias("_o")).distinct()
    unfinished = F.col("status").isin("partial", "dead-link")
    kept = log.withColumn("_o", plain)
    done = kept.filter(~unfinished)
    open_rows = kept.filter(unfinished).join(keys, ["year", "_o"], "left_anti")
    return done.unionByName(open_rows).drop("_o").unionByName(fresh.select(*log.columns))


def publisher_names(df: DataFrame) -> DataFrame:
    return display_name(df, "outlet", fr.OUTLET_NAMES)
