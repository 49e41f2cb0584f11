"""Matching names, articles and dictionary entries without comparing everything with everything."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from hearthbook.functions.names import edit_score, match_status, normalize_name, title_case
from hearthbook.functions.text import all_matches, let, word_overlap
from hearthbook.operators.dictionary import best_dictionary_match, match_dictionary, mentions  # noqa: F401
from hearthbook.session import materialise

# Score bands of the edit-distance search, strictest first.
BANDS = (90, 75, 60)


def _lead(df: DataFrame, keys: Sequence[str], rank: str) -> DataFrame:
    """Best page per key; ties go to the smaller rank."""
    return df.groupBy(*keys).agg(F.min(F.struct(rank, "page")).alias("_best"))


def _name_index(df: DataFrame, name: str) -> DataFrame:
    """Distinct normalised names with the parts the rules look at."""
    n = normalize_name(F.col(name))
    parts = F.split(F.col("norm"), " ")
    many = F.size(parts) >= 2
    return (
        df.withColumn("norm", n).filter(F.col("norm") != "")
        .withColumn("_last", F.when(many, F.element_at(parts, -1)))
        .withColumn("_first", F.when(many, F.get(parts, F.lit(0))))
    )


def segment_count(length: Column, score: int) -> Column:
    """Pieces a name is cut into so that one survives every allowed edit.

    A pair at or above ``score`` differs by at most ``(1 - score/100) * longer`` edits, and the
    longer name has at most ``shorter * 100 / score`` letters.
    """
    edits = F.floor(length * F.lit((100 - score) / score) + F.lit(1e-9))
    return F.least(edits + 1, length).cast("int")


def _segments(names: DataFrame, score: int) -> DataFrame:
    """(norm, cut, index, piece) of the stored side: even pieces at known places."""
    n = F.length("norm")
    k = segment_count(n, score)
    cut = names.withColumn("_k", k)
    piece = F.explode(F.transform(F.sequence(F.lit(0), F.col("_k") - 1), lambda i: F.struct(
        i.alias("i"),
        F.floor(i * n / F.col("_k")).cast("int").alias("at"),
        (F.floor((i + 1) * n / F.col("_k")) - F.floor(i * n / F.col("_k"))).cast("int").alias("w"),
    )))
    flat = cut.select("*", n.alias("_n"), piece.alias("_p"))
    return flat.select(
        *names.columns, F.col("_n").alias("r_len"), F.col("_p.at").alias("at"), F.col("_p.w").alias("w"),
        F.substr("norm", F.col("_p.at") + 1, F.col("_p.w")).alias("piece"),
    )


def _probes(left: DataFrame, shapes: DataFrame, score: int) -> DataFrame:
    """Pieces of the searching side at every place a stored piece may have moved to.

    ``shapes`` holds the (length, place, width) layouts that exist: a few per name length.
    """
    share = F.lit((100 - score) / 100)
    lengths = F.sequence(
        F.ceil(F.col("r_len") * score / 100 - 1e-9).cast("int"), F.floor(F.col("r_len") * 100 / score + 1e-9).cast("int")
    )
    edits = F.floor(F.greatest("l_len", "r_len") * share + F.lit(1e-9)).cast("int")
    layout = shapes.withColumn("l_len", F.explode(lengths)).withColumn("_e", edits)
    lo, hi = F.greatest(F.lit(0), F.col("at") - F.col("_e")), F.least(F.col("at") + F.col("_e"), F.col("l_len") - F.col("w"))
    layout = layout.filter(lo <= hi).select("l_len", "r_len", "at", "w", F.explode(F.sequence(lo, hi)).alias("from"))
    ours = left.select("norm", F.length("norm").alias("l_len")).distinct()
    return ours.join(layout, "l_len").select(
        "norm", "r_len", "at", "w", F.substr("norm", F.col("from") + 1, F.col("w")).alias("piece")
    ).distinct()


def _near(left: DataFrame, right: DataFrame, score: int) -> DataFrame:
    """Best page of every left name among all right names with edit score >= ``score``."""
    stored = _segments(right, score)
    shapes = stored.select("r_len", "at", "w").distinct()
    probes = _probes(left, shapes, score)
    keys = ["r_len", "at", "w", "piece"]
    found = probes.join(
        stored.select(*keys, F.col("norm").alias("r_norm"), "rank", "page"), keys
    ).select("norm", "r_norm", "rank", "page")
    s = edit_score(F.col("norm"), F.col("r_norm"))
    l_parts, r_parts = F.split("norm", " "), F.split("r_norm", " ")
    same_last = (
        (F.size(l_parts) >= 2) & (F.size(r_parts) >= 2)
        & (F.element_at(l_parts, -1) == F.element_at(r_parts, -1))
    )
    near = found.withColumn("score", s).filter((F.col("score") >= score) & ~same_last)
    return near.groupBy("norm").agg(F.min(F.struct((-F.col("score")).alias("s"), "rank", "page")).alias("_b"))


def fuzzy_match(
    left: DataFrame, right: DataFrame, left_name: str, right_name: str, page: str, rank: str,
    bands: Sequence[int] = BANDS,
) -> DataFrame:
    """Best page for each distinct left name with score >= the lowest band, and its status.

    ``right`` has one row per page name or alias, with ``rank`` breaking ties. Rules that need equal
    last names join on those parts against one row per part, so no block is paired with itself.
    Edit-distance matches come from a lossless piece index, strictest band first: a name found in a
    band is done, because every better match would have been in that band too.
    """
    names = left.select(F.col(left_name).alias("_raw")).distinct()
    ours = _name_index(names, "_raw")
    theirs = right.select(F.col(right_name).alias("_raw"), F.col(page).alias("page"), F.col(rank).alias("rank"))
    # One row per stored name: its first page wins every tie.
    stored = _name_index(theirs, "_raw").groupBy("norm", "_first", "_last").agg(
        F.min(F.struct("rank", "page")).alias("_b")).select(
        "norm", "_first", "_last", F.col("_b.rank").alias("rank"), F.col("_b.page").alias("page"))
    stored = materialise(stored, "names")
    prefixed = stored.withColumn("_pre", F.substring("_first", 1, 3))
    uniq = materialise(ours.select("norm", "_first", "_last").distinct().withColumn("_pre", F.substring("_first", 1, 3)), "names")

    ruled = []
    for keys, score in ((["norm"], 100), (["_first", "_last"], 95), (["_pre", "_last"], 85), (["_last"], 70)):
        ruled.append(
            uniq.join(_lead(prefixed.dropna(subset=keys), keys, "rank"), keys).select(
                "norm", F.struct(F.lit(-float(score)).alias("s"), F.col("_best.rank").alias("rank"),
                                 F.col("_best.page").alias("page")).alias("_b"))
        )
    best = reduce(DataFrame.unionByName, ruled).groupBy("norm").agg(F.min("_b").alias("_b"))
    best = materialise(best, "names")

    found, open_names, settled = [best], uniq.select("norm"), 100
    for band in bands:
        done = reduce(DataFrame.unionByName, found).filter(-F.col("_b.s") >= settled).select("norm").distinct()
        open_names = open_names.join(done, "norm", "left_anti")
        if open_names.isEmpty():
            break
        found.append(materialise(_near(open_names, stored, band), "names"))
        settled = band
    every = reduce(DataFrame.unionByName, found).groupBy("norm").agg(F.min("_b").alias("_b"))
    return ours.join(every, "norm").select(
        F.col("_raw").alias(left_name), F.col("_b.page").alias("matched_page"),
        (-F.col("_b.s")).alias("score"), match_status(-F.col("_b.s")).alias("status"))


def review_list(matches: DataFrame) -> DataFrame:
    """Matches a person should look at."""
    return matches.filter(F.col("status") == "needs_review")


# -- articles and notes -------------------------------------------------------------------------


def _long_words(c: Column) -> Column:
    return F.array_distinct(F.filter(all_matches(F.lower(c), r"\w+"), lambda w: F.length(w) > 4))


def _keyed_words(here: DataFrame, there: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(id, year, word) of both sides without the ``least - 1`` most frequent words of each set.

    Two sets that share ``least`` words share one of the others: their words are put in one order, by frequency on both
    sides, and of the shared words the first stands before the last ``least - 1`` places of either set.
    """
    sides = [df.select("id", "year", F.explode("words").alias("word")) for df in (here, there)]
    often = sides[0].unionByName(sides[1]).groupBy("year", "word").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("id", "year").orderBy(F.desc("n"), F.desc("word")))
    return tuple(s.join(often, ["year", "word"]).withColumn("_at", place).filter(F.col("_at") >= least).select("id", "year", "word") for s in sides)


def article_candidates(articles: DataFrame, notes: DataFrame, least: int = 2) -> DataFrame:
    """(article_id, file, words, file_words) of articles and notes of one year that share a word other than their most frequent ones."""
    years = F.explode(F.array_distinct(F.regexp_extract_all("file", F.lit(r"(?=(\d{4}))"), F.lit(1))))
    there = notes.select("file").distinct().select(F.col("file").alias("id"), years.alias("year"), _long_words(F.col("file")).alias("words"))
    here = articles.select(F.col("article_id").alias("id"), F.col("year").cast("string").alias("year"), _long_words(F.col("headline")).alias("words"))
    ours, theirs = _keyed_words(here, there, least)
    met = ours.withColumnRenamed("id", "article_id").join(theirs.withColumnRenamed("id", "file"), ["year", "word"])
    pairs = met.select("article_id", "file", "year").distinct()
    with_ours = pairs.join(here.select(F.col("id").alias("article_id"), "year", "words"), ["article_id", "year"])
    return with_ours.join(there.select(F.col("id").alias("file"), "year", F.col("words").alias("file_words")), ["file", "year"])


def match_articles(articles: DataFrame, notes: DataFrame, least: int = 2) -> DataFrame:
    """First existing note that holds the year, a publisher word and ``least`` long headline words.

    ``articles``: article_id, headline, publisher, year. ``notes``: file. Articles meet notes on year and any shared word
    but the most frequent, so a word in every headline brings nothing together.
    """
    close = article_candidates(articles, notes, least)
    shared = close.filter(F.size(F.array_intersect("words", "file_words")) >= least).select("article_id", "file").distinct()
    named = shared.join(articles.select("article_id", "publisher"), "article_id")
    pub_words = F.filter(F.split(F.lower("publisher"), r"\s+"), lambda w: F.length(w) > 3)
    kept = named.filter(F.exists(pub_words, lambda w: F.contains(F.lower("file"), w)))
    return kept.groupBy("article_id").agg(F.min("file").alias("file"))


def display_name(df: DataFrame, slug: str, mapping: dict[str, str]) -> DataFrame:
    """Proper name of a slug; unknown slugs are spelled out."""
    lookup = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    spelled = title_case(F.replace(F.col(slug), F.lit("-"), F.lit(" ")))
    return df.withColumn("display_name", F.coalesce(F.try_element_at(lookup, F.col(slug)), spelled))


def has_page(df: DataFrame, participants: str, pages: DataFrame, key: str) -> DataFrame:
    """Flag rows of which any participant has a people page."""
    wanted = pages.select(F.col("title").alias("_p")).distinct().withColumn("_hit", F.lit(True))
    people = df.select(key, F.explode_outer(participants).alias("_p")).distinct()
    flags = people.join(wanted, "_p", "left").groupBy(key).agg(F.max(F.coalesce("_hit", F.lit(False))).alias("has_page"))
    return df.join(flags, key, "left")


def with_text(entries: DataFrame, ocr: DataFrame, keys: Sequence[str] = ("stem", "month")) -> DataFrame:
    """Attach the full text of an entry, else its preview."""
    full = ocr.select(*keys, F.col("text").alias("_full"))
    return entries.join(full, list(keys), "left").withColumn(
        "text", F.coalesce("_full", "text_preview", F.lit(""))).drop("_full")


def with_attachment(notes: DataFrame, files: DataFrame, ext_rank: Sequence[str]) -> DataFrame:
    """Attach the file of the same month and stem with the most wanted extension."""
    rank = F.array_position(F.array(*[F.lit(e) for e in ext_rank]), F.col("ext"))
    best = files.filter(rank > 0).groupBy("month", "stem").agg(
        F.min(F.struct(rank.alias("r"), F.col("path"))).alias("_f"))
    return notes.join(best, ["month", "stem"], "left").withColumn("attachment", F.col("_f.path")).drop("_f")
