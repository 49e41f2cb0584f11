"""Checks over a note collection. Every check gives (check, path, detail)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from hearthbook.functions.media import parent
from hearthbook.functions.text import matches, occurs, strip
from hearthbook.rulesets import files as fr


def _finding(df: DataFrame, check: str, path: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(check).alias("check"), path.alias("path"), detail.cast("string").alias("detail"))


def note_links(notes: DataFrame, path: str = "path", body: str = "body") -> DataFrame:
    """(src, target) for every wikilink, aliases removed, each pair once."""
    found = F.regexp_extract_all(body, F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1))
    links = notes.select(F.col(path).alias("src"), F.explode(found).alias("raw"))
    return links.select("src", F.substring_index("raw", "|", 1).alias("target")).filter(F.col("target") != "").distinct()


def broken_links(links: DataFrame, notes: DataFrame, allowed: Sequence[str] = tuple(fr.ALLOWED_DANGLING)) -> DataFrame:
    """Links without a page: by file name, or by path with or without the extension."""
    wanted = links.filter(~F.col("target").isin(list(allowed)))
    names = notes.select(F.col("title").alias("target")).distinct()
    paths = notes.select(F.regexp_replace("path", r"\.md$", "").alias("_p")).distinct()
    by_path = F.contains("target", F.lit("/"))
    bare = wanted.filter(~by_path).join(names, "target", "left_anti")
    full = wanted.filter(by_path).withColumn("_p", F.regexp_replace("target", r"\.md$", "")).join(paths, "_p", "left_anti")
    missing = bare.select("src", "target").unionByName(full.select("src", "target"))
    return _finding(missing, "broken_link", F.col("src"), F.col("target"))


def stubs(notes: DataFrame, least: int = 5) -> DataFrame:
    lines = F.size(F.filter(F.split(F.coalesce("body", F.lit("")), "\n"), lambda x: strip(x) != ""))
    return _finding(notes.withColumn("_n", lines).filter(F.col("_n") < least), "stub", F.col("path"), F.col("_n"))


def duplicates(notes: DataFrame) -> DataFrame:
    """Names that occur in more than one folder."""
    per_dir = notes.groupBy("title", parent(F.col("path")).alias("dir")).agg(F.lit(1).alias("_one"))
    many = per_dir.groupBy("title").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    return _finding(many, "duplicate_name", F.col("title"), F.col("n"))


def orphans(notes: DataFrame, links: DataFrame, types: Sequence[str] = ("canon", "project", "output")) -> DataFrame:
    """Pages of the given types nobody links to."""
    target = F.regexp_replace(F.substring_index("target", "/", -1), r"\.md$", "")
    linked = links.select(target.alias("title")).distinct()
    return _finding(notes.filter(F.col("type").isin(list(types))).join(linked, "title", "left_anti"),
                    "orphan", F.col("path"), F.col("type"))


def missing_frontmatter(notes: DataFrame) -> DataFrame:
    def blank(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit("")) == ""
    what = F.concat_ws(",", F.when(blank("type"), "type"), F.when(blank("status"), "status"))
    return _finding(notes.filter(blank("type") | blank("status")), "missing_frontmatter", F.col("path"), what)


# Folder names that state a project status.
STATUS_FOLDERS = {"active": "Active", "archived": "Archived", "dormant": "Dormant", "incubating": "Incubating"}


def status_mismatch(notes: DataFrame, folders=STATUS_FOLDERS) -> DataFrame:
    """Projects whose folder states another status than the page."""
    place = F.regexp_extract("path", "(?:^|/)(" + "|".join(folders.values()) + ")/", 1)
    bad = (F.col("type") == "project") & (place != "") & (F.lower(place) != F.lower("status"))
    return _finding(notes.filter(bad), "status_mismatch", F.col("path"), F.concat_ws(" in ", "status", place))


def naming(notes: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Pages whose name does not fit the pattern of their type."""
    ok = F.lit(True)
    for kind, pattern in rules.items():
        ok = F.when(F.col("type") == kind, matches(F.col("title"), pattern)).otherwise(ok)
    return _finding(notes.filter(~ok), "naming", F.col("path"), F.col("type"))


def concepts(links: DataFrame, notes: DataFrame, least: int = 3) -> DataFrame:
    """Terms linked from ``least`` files that have no page."""
    used = links.select("target", "src").distinct().groupBy("target").agg(F.count(F.lit(1)).alias("n"))
    missing = used.filter(F.col("n") >= least).join(notes.select(F.col("title").alias("target")).distinct(), "target", "left_anti")
    return _finding(missing, "concept_without_page", F.col("target"), F.col("n"))


def stale(notes: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    age = F.datediff(F.lit(as_of).cast("date"), F.col("last_updated"))
    return _finding(notes.withColumn("_age", age).filter(F.col("_age") > days), "stale", F.col("path"), F.col("_age"))


def underlinked(notes: DataFrame, links: DataFrame, least: int = 2, kind: str = "canon") -> DataFrame:
    """Pages of a type with fewer than ``least`` outbound links."""
    out = links.groupBy(F.col("src").alias("path")).agg(F.count(F.lit(1)).alias("n"))
    joined = notes.filter(F.col("type") == kind).join(out, "path", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return _finding(joined.filter(F.col("n") < least), "underlinked", F.col("path"), F.col("n"))


def not_empty(paths: DataFrame, folders: Sequence[str] = tuple(fr.EMPTY_FOLDERS)) -> DataFrame:
    """Content folders that should hold no files, with their file count."""
    name = F.substring_index("path", "/", -1)
    real = paths.filter(~name.isin(".DS_Store", ".gitkeep"))
    top = F.substring_index("path", "/", 1)
    counted = real.filter(top.isin(list(folders))).groupBy(top.alias("dir")).agg(F.count(F.lit(1)).alias("n"))
    return _finding(counted, "not_empty", F.col("dir"), F.col("n"))


def leak_report(texts: DataFrame, rules: Sequence[tuple[str, ...]], path: str = "path", body: str = "body",
                only: str | None = None, skip: str | None = None) -> DataFrame:
    """(category, pattern, path, line_no, line) of every line that matches a private pattern.

    A rule is (pattern, category) or (pattern, category, allowed): a line that also matches ``allowed`` is no
    hit. Rules see one line at a time, so that ``^`` and ``$`` mean its ends. ``only`` and ``skip`` are
    patterns of paths to look at and to leave out.
    """
    if only:
        texts = texts.filter(F.col(path).rlike(only))
    if skip:
        texts = texts.filter(~F.col(path).rlike(skip))
    lines = texts.select(F.col(path).alias("path"), F.posexplode(F.split(body, "\n")).alias("_no", "line"))
    tested = F.filter(F.array(*[
        F.when(occurs(F.col("line"), p) & (~occurs(F.col("line"), allowed[0]) if allowed else F.lit(True)),
               F.struct(F.lit(c).alias("category"), F.lit(p).alias("pattern")))
        for p, c, *allowed in rules]), lambda x: x.isNotNull())
    return lines.select(F.inline(tested), "path", (F.col("_no") + 1).alias("line_no"), "line")


def scan_patterns(texts: DataFrame, rules: Sequence[tuple[str, str]], path: str = "path", body: str = "body") -> DataFrame:
    """Hits per pattern and category."""
    return leak_report(texts, rules, path, body).groupBy("category", "pattern").agg(F.count(F.lit(1)).alias("lines"))


def by_authority(claims: DataFrame, order: str = "source") -> DataFrame:
    """Winning value per (entity, attribute): lowest level, then ``order``; conflicts are counted."""
    values = claims.groupBy("entity", "attribute", "value").agg(F.min(F.struct("level", F.col(order).alias("o"))).alias("_k"))
    return values.groupBy("entity", "attribute").agg(
        F.min(F.struct("_k", "value")).alias("_b"), (F.count(F.lit(1)) - 1).alias("n_conflicts")
    ).select("entity", "attribute", F.col("_b.value").alias("value"), F.col("_b._k.level").alias("level"), "n_conflicts")


def confidence(citations: DataFrame, page: str = "page", tag: str = "tag") -> DataFrame:
    """``high`` with two strong sources and a strong majority, ``medium`` with any strong or half secondary."""
    strong = F.count_if(F.col(tag).isin("primary", "institutional"))
    weak = F.count_if(F.col(tag).isin("opinion", "aggregator"))
    counted = citations.groupBy(page).agg(
        F.count(F.lit(1)).alias("citations"), strong.alias("strong"), weak.alias("weak"))
    level = (
        F.when((F.col("strong") >= 2) & (F.col("strong") * 2 > F.col("citations")), "high")
        .when((F.col("strong") >= 1) | (F.col("weak") * 2 < F.col("citations")), "medium").otherwise("low"))
    return counted.withColumn("confidence", level)


def drift(projects: DataFrame, activity: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """Active projects without evidence in the last ``days`` days."""
    recent = activity.filter(F.datediff(F.lit(as_of).cast("date"), F.col("ts").cast("date")).between(0, days))
    return projects.filter(F.lower("status") == "active").join(recent.select("project").distinct(), "project", "left_anti")


