"""Social archives: people counts, threads, contact score, activity."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from hearthbook.functions import scores as sc
from hearthbook.functions.dates import period_key
from hearthbook.operators.ordering import cap_per_group, rank_tiers
from hearthbook.rulesets import chat


def people_counts(posts: DataFrame, comments: DataFrame, thread_sizes: DataFrame, owner: str) -> DataFrame:
    """How often each person appears: posts and comments count one, threads their length.

    ``posts`` and ``comments`` have author; ``thread_sizes`` has person and messages.
    """
    streams = posts.select(F.col("author").alias("person"), F.lit(1).cast("bigint").alias("n")).unionByName(
        comments.select(F.col("author").alias("person"), F.lit(1).cast("bigint").alias("n"))
    ).filter(F.col("person") != owner).unionByName(
        thread_sizes.select("person", F.col("messages").cast("bigint").alias("n")))
    known = streams.filter(F.col("person") != "Unknown")
    return known.groupBy("person").agg(F.sum("n").alias("appearances"))


def thread_sizes(messages: DataFrame, thread: str, author: str, owner: str) -> DataFrame:
    """(thread, person, messages): each participant with the length of the thread."""
    per_author = messages.groupBy(thread, author).agg(F.count(F.lit(1)).alias("n"))
    size = per_author.groupBy(thread).agg(F.sum("n").alias("messages"))
    people = per_author.filter(~F.col(author).isin(owner, "Unknown")).select(thread, F.col(author).alias("person"))
    return people.join(size, thread)


def merge_threads(threads: DataFrame) -> DataFrame:
    """Threads of the same participants become one: message count and number of threads."""
    name = F.array_join(F.array_sort(F.array_distinct("participants")), ", ")
    keyed = threads.withColumn("name", F.when(name == "", "Unknown").otherwise(name))
    return keyed.groupBy("name").agg(
        F.sum("messages").alias("messages"), F.count(F.lit(1)).alias("threads"),
        F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))


def one_to_few(threads: DataFrame, most: int = 3) -> DataFrame:
    """Threads with one to ``most`` participants of whom one is known."""
    people = F.col("participants")
    return threads.filter(
        (F.size(people) > 0) & (F.size(people) <= most) & ~F.forall(people, lambda p: p == "Unknown"))


def posts_by_period(posts: DataFrame, ts: str) -> DataFrame:
    """Posts per year and month with yearly totals."""
    keyed = posts.select(period_key(F.col(ts), "year").alias("year"), period_key(F.col(ts), "month").alias("month"))
    return keyed.rollup("year", "month").agg(F.count(F.lit(1)).alias("posts"))


def top_people_per_year(posts: DataFrame, ts: str, person: str, n: int = 15) -> DataFrame:
    """Most active people of each year."""
    counted = posts.groupBy(F.year(ts).alias("year"), F.col(person).alias("person")).agg(F.count(F.lit(1)).alias("posts"))
    return cap_per_group(counted, ["year"], [F.desc("posts"), F.asc("person")], n, "rank")


def person_threads(threads: DataFrame, thread: str) -> DataFrame:
    """(person, thread) of everyone who takes part."""
    return threads.select(F.explode("participants").alias("person"), thread).distinct()


def person_posts(posts: DataFrame, post: str) -> DataFrame:
    """(person, post) of everyone who wrote or commented."""
    everyone = F.array_union(F.array("author"), F.transform("comments", lambda c: c["author"]))
    return posts.select(F.explode(everyone).alias("person"), post, "ts").filter(F.col("person") != "Unknown")


def person_month_activity(person_posts_: DataFrame, ts: str = "ts") -> DataFrame:
    return person_posts_.groupBy("person", period_key(F.col(ts), "month").alias("month")).agg(
        F.count(F.lit(1)).alias("posts"))


def contact_score(
    messages: DataFrame,
    thread: str,
    is_owner: Column,
    text: str,
    order: Sequence[str],
    ts: str | None = None,
    present: DataFrame | None = None,
    professional: Sequence[str] = tuple(chat.PROFESSIONAL_WORDS),
    warmth: Sequence[str] = tuple(chat.WARMTH_WORDS),
    followup: Sequence[str] = tuple(chat.FOLLOWUP_WORDS),
    tags: Mapping[str, Sequence[str]] = chat.TAG_WORDS,
    recency: Mapping[int, int] = chat.RECENCY_POINTS,
) -> DataFrame:
    """Eight sub-scores, total, tags and snippet of each thread, from message rows.

    Keyword presence is one bit per word; bits combine on the map side, so a thread of any length
    shuffles as a few numbers.
    """
    tag_words = list(dict.fromkeys(w for ws in tags.values() for w in ws))
    low = messages.withColumn("_low", F.lower(F.coalesce(F.col(text), F.lit("")))).withColumn("_own", is_owner)
    size = F.length(text)
    candidate = F.struct((-size).alias("n"), *[F.col(o) for o in order], F.col(text).alias("text"))
    grouped = low.groupBy(thread).agg(
        F.count(F.lit(1)).alias("messages"),
        F.count_if("_own").alias("own"), F.count_if(~F.col("_own")).alias("other"),
        F.sum(size).alias("_chars"),
        F.bit_or(sc.word_mask(F.col("_low"), list(professional))).alias("_pro"),
        F.bit_or(sc.word_mask(F.col("_low"), list(warmth))).alias("_warm"),
        F.bit_or(sc.word_mask(F.col("_low"), list(followup))).alias("_follow"),
        F.bit_or(sc.word_mask(F.col("_low"), tag_words)).alias("_tags"),
        F.min(F.when(~F.col("_own") & (size < 300), candidate)).alias("_best_other"),
        F.min(F.when(F.col("_own") & (size < 300), candidate)).alias("_best_own"),
        (F.max(F.year(ts)) if ts else F.lit(None).cast("int")).alias("_year"),
    )
    if present is not None:
        grouped = grouped.join(present.select(thread).distinct().withColumn("_wall", F.lit(True)), thread, "left")
    else:
        grouped = grouped.withColumn("_wall", F.lit(None).cast("boolean"))
    parts = (
        grouped.withColumn("depth", sc.depth_points(F.col("messages")))
        .withColumn("reciprocity", sc.reciprocity_points(F.col("own"), F.col("other")))
        .withColumn("professional", sc.hit_points(F.bit_count("_pro"), 2, 25))
        .withColumn("warmth", sc.hit_points(F.bit_count("_warm"), 3, 15))
        .withColumn("followup_intent", sc.hit_points(F.bit_count("_follow"), 3, 15))
        .withColumn("recency", sc.recency_points(F.col("_year"), dict(recency)))
        .withColumn("wall_presence", F.when(F.col("_wall"), 5).otherwise(0))
        .withColumn("substance", sc.substance_points(F.col("_chars") / F.col("messages")))
    )
    names = ["depth", "reciprocity", "professional", "warmth", "followup_intent", "recency", "wall_presence", "substance"]
    total = sum((F.col(n) for n in names), F.lit(0))
    tagged = sc.contact_tags(F.col("professional"), F.col("warmth"), F.col("followup_intent"), F.col("_tags"), tag_words,
                             {k: list(v) for k, v in tags.items()})
    best = F.coalesce(F.nullif("_best_other.text", F.lit("")), F.nullif("_best_own.text", F.lit("")), F.lit(""))
    return parts.select(
        thread, "messages", *names, total.alias("score"), tagged.alias("tags"), sc.cut_snippet(best).alias("snippet"))


def score_message_notes(notes: DataFrame) -> DataFrame:
    """The same score for rendered thread notes: one row per note, its text searched as a whole."""
    low = F.lower("body")
    own, other = F.size("owner_messages"), F.size("other_messages")
    every = F.concat("owner_messages", "other_messages")
    chars = F.aggregate(every, F.lit(0), lambda a, m: a + F.length(m))
    tag_words = list(dict.fromkeys(w for ws in chat.TAG_WORDS.values() for w in ws))
    staged = notes.withColumn("_low", low)
    masks = {"professional": chat.PROFESSIONAL_WORDS, "warmth": chat.WARMTH_WORDS, "followup_intent": chat.FOLLOWUP_WORDS}
    out = (
        staged.withColumn("depth", sc.depth_points(F.col("message_count")))
        .withColumn("reciprocity", sc.reciprocity_points(own, other))
        .withColumn("professional", sc.hit_points(F.bit_count(sc.word_mask(F.col("_low"), masks["professional"])), 2, 25))
        .withColumn("warmth", sc.hit_points(F.bit_count(sc.word_mask(F.col("_low"), masks["warmth"])), 3, 15))
        .withColumn("followup_intent", sc.hit_points(F.bit_count(sc.word_mask(F.col("_low"), masks["followup_intent"])), 3, 15))
        .withColumn("recency", sc.recency_points(F.regexp_extract("last_date", r"(\d{4})", 1).try_cast("int")))
        .withColumn("wall_presence", F.when(F.coalesce("has_page", F.lit(False)), 5).otherwise(0))
        .withColumn("substance", sc.substance_points(chars / F.greatest(F.size(every), F.lit(1))))
        .withColumn("_tags", sc.word_mask(F.col("_low"), tag_words))
        .withColumn("snippet", sc.snippet(F.col("other_messages"), F.col("owner_messages")))
    )
    names = ["depth", "reciprocity", "professional", "warmth", "followup_intent", "recency", "wall_presence", "substance"]
    out = out.withColumn("score", sum((F.col(n) for n in names), F.lit(0)))
    tags = sc.contact_tags(F.col("professional"), F.col("warmth"), F.col("followup_intent"), F.col("_tags"), tag_words)
    return out.withColumn("tags", tags).drop("_low", "_tags")


def contact_ranking(scored: DataFrame, name: str, sizes: Sequence[int] = (25, 35, 40)) -> DataFrame:
    """Top 100 in three tiers."""
    return rank_tiers(scored, "score", name, sizes)


def tag_counts(df: DataFrame, tags: str = "tags") -> DataFrame:
    return df.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("contacts"))
