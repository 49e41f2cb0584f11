"""Entities in long form, canonical names, profiles and scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from hearthbook.functions import scores as sc
from hearthbook.functions.entities import extractors
from hearthbook.functions.names import blocked_entity, blocked_person
from hearthbook.functions.text import clean_lines, url_domain
from hearthbook.operators.ordering import cap_per_group
from hearthbook.rulesets import entities as ent

PERSON, ORG, PRODUCT, DOMAIN = "person", "service", "product", "domain"


def entities_wide(df: DataFrame, text: str, category: str | None = None, kinds: Sequence[str] = tuple(ent.KINDS),
                  caps=ent.KIND_CAPS) -> DataFrame:
    """Add one array column per entity kind."""
    cleaned = df.withColumn("_clean", clean_lines(F.col(text)))
    cols = extractors(F.col("_clean"), F.col(category) if category else None, caps, kinds)
    return cleaned.select(*df.columns, *[cols[k].alias(k) for k in kinds])


def entities_long(df: DataFrame, id_col: str, text: str, category: str | None = None,
                  kinds: Sequence[str] = tuple(ent.KINDS), caps=ent.KIND_CAPS) -> DataFrame:
    """(id, kind, value, pos) for every entity of every text."""
    wide = entities_wide(df, text, category, kinds, caps)
    def tag(kind: str) -> Column:
        return F.transform(kind, lambda v, i: F.struct(F.lit(kind).alias("kind"), v.alias("value"), i.alias("pos")))

    tagged = F.flatten(F.array(*[tag(k) for k in kinds]))
    return wide.select(id_col, F.inline(tagged))


def entity_totals(long: DataFrame, id_col: str) -> DataFrame:
    """Values and texts per kind."""
    per_text = long.groupBy("kind", id_col).agg(F.count(F.lit(1)).alias("n"))
    return per_text.groupBy("kind").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("texts"))


def entity_index(long: DataFrame, id_col: str, kind: str, shown: int = 5) -> DataFrame:
    """Each value of a kind with its number of sources, the first ``shown`` of them and the rest count."""
    pairs = long.filter(F.col("kind") == kind).select("value", id_col).distinct()
    n = pairs.groupBy("value").agg(F.count(F.lit(1)).alias("sources"))
    first = cap_per_group(pairs, ["value"], [F.asc(id_col)], shown).groupBy("value").agg(
        F.array_sort(F.collect_list(id_col)).alias("first_sources"))
    rest = F.greatest(F.col("sources") - shown, F.lit(0))
    return n.join(first, "value").withColumn("more", rest)


def merge_table(spark, merge: Mapping[str, str]) -> DataFrame:
    """Alias table from a mapping of lower-case alias to canonical name."""
    rows = [(k.lower().strip(), v) for k, v in merge.items()]
    return spark.createDataFrame(rows, "alias string, canonical string")


def canonicalise(entities: DataFrame, merge: DataFrame, name: str = "name", kind: str = "kind") -> DataFrame:
    """Replace aliases by canonical names; an organisation mark moves the entity to that kind."""
    keyed = entities.withColumn("_k", F.lower(F.trim(name)))
    joined = keyed.join(merge.select(F.col("alias").alias("_k"), F.col("canonical").alias("_c")), "_k", "left")
    moved = F.startswith(F.col("_c"), F.lit(ent.ORG_PREFIX))
    return (
        joined.withColumn(kind, F.when(moved & (F.col(kind) == PERSON), ORG).otherwise(F.col(kind)))
        .withColumn(name, F.when(F.col("_c").isNull(), F.col(name)).otherwise(
            F.replace("_c", F.lit(ent.ORG_PREFIX), F.lit(""))))
        .drop("_k", "_c")
    )


def named_entities(wide: DataFrame, id_cols: Sequence[str], merge: DataFrame) -> DataFrame:
    """(ids, kind, name, contact data) rows of people, services, products and domains after clean-up."""
    arrays = ["handles", "emails", "phones", "urls", "prices", "addresses"]

    def tagged(values: Column, kind: str) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("name")))

    hosts = F.filter(F.transform("urls", url_domain), lambda d: d.isNotNull())
    every = F.concat(tagged(F.col("people"), PERSON), tagged(F.col("services"), ORG),
                     tagged(F.col("products"), PRODUCT), tagged(hosts, DOMAIN))
    rows = wide.select(*id_cols, *arrays, F.inline(every))
    blocked = F.when(F.col("kind") == PERSON, blocked_person(F.col("name"))).otherwise(
        blocked_entity(F.col("kind"), F.col("name")))
    people_kept = rows.filter(~blocked)
    return canonicalise(people_kept, merge)


VALUES = ("handles", "emails", "phones", "urls", "prices", "addresses")


def entity_values(rows: DataFrame, month: str, category: str, values: Sequence[str] = VALUES) -> DataFrame:
    """(kind, name, what, value): every distinct month, category and contact value of every entity.

    Kept in long form: the values of a name that is on a third of all texts never meet in one row.
    """
    sets = {"months": F.array(F.col(month)), "categories": F.array(F.col(category)), **{v: F.col(v) for v in values if v in rows.columns}}

    def tag(what: str, values_: Column) -> Column:
        return F.transform(values_, lambda v: F.struct(F.lit(what).alias("what"), v.cast("string").alias("value")))

    tagged = F.flatten(F.array(*[tag(k, v) for k, v in sets.items()]))
    return rows.select("kind", "name", F.inline(tagged)).distinct()


def entity_profiles(rows: DataFrame, month: str, category: str, relevant: Sequence[str] = tuple(ent.RELEVANT_CATEGORIES)) -> DataFrame:
    """One row per (kind, name): mentions, seen range and the number of distinct values of each sort."""
    base = rows.groupBy("kind", "name").agg(
        F.count(F.lit(1)).alias("n"), F.min(month).alias("first_seen"), F.max(month).alias("last_seen"))
    what = F.col("what")
    counted = entity_values(rows, month, category).groupBy("kind", "name").agg(
        *[F.count_if(what == k).alias(k) for k in ("months", "categories", *VALUES)],
        F.count_if((what == "categories") & F.col("value").isin(list(relevant))).alias("relevant_categories"))
    return base.join(counted, ["kind", "name"])


def entity_score(profile: DataFrame, as_of: str) -> DataFrame:
    """Add the five parts of the 25-point score, the total and the tier."""
    last = F.to_date(F.concat(F.col("last_seen"), F.lit("-01")))
    has = {c: F.col(c) > 0 for c in ("emails", "phones", "handles", "urls")}
    out = (
        profile.withColumn("recency", sc.entity_recency(last, as_of))
        .withColumn("repetition", sc.entity_repetition(F.col("n")))
        .withColumn("contactability", sc.entity_contactability(has["emails"], has["phones"], has["handles"], has["urls"]))
        .withColumn("relevance", sc.entity_relevance(F.col("relevant_categories"), F.col("n")))
        .withColumn("confidence", sc.entity_confidence(F.col("n"), has["emails"] | has["phones"], F.col("months")))
    )
    total = F.col("recency") + F.col("repetition") + F.col("contactability") + F.col("relevance") + F.col("confidence")
    return out.withColumn("total", total).withColumn("tier", sc.entity_tier(F.col("total")))


def score_tiers(scored: DataFrame) -> DataFrame:
    """Entities per score tier and kind."""
    tiers = ["20-25 Immediate", "15-19 Research", "10-14 Archive", "0-9 Ignore"]
    counted = scored.groupBy("kind").pivot("tier", tiers).agg(F.count(F.lit(1)))
    return counted.fillna(0)
