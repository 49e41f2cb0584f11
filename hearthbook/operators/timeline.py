"""Timeline of events and the cast of contacts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from hearthbook.functions import dates as fd, scores as sc
from hearthbook.functions.text import normalise_subject
from hearthbook.operators.classify import event_type, narrative_role
from hearthbook.operators.ordering import cap_per_group, dedup_first


def timeline_events(threads: DataFrame) -> DataFrame:
    """Threads that speak of an event, one per day and subject, earliest first.

    A reply chain is one subject; two subjects that merely begin alike are two events.
    Needs ts, subject, body, contact_email; other columns pass through.
    """
    dated = threads.filter(F.col("ts").isNotNull() & (F.coalesce("subject", F.lit("")) != ""))
    typed = dated.withColumn("event_type", event_type(F.col("subject"), F.col("body"))).filter(
        F.col("event_type").isNotNull())
    keyed = typed.withColumn("date", F.to_date("ts")).withColumn("_s", normalise_subject(F.col("subject")))
    once = dedup_first(keyed, ["date", "_s"], [F.asc("ts"), F.asc("contact_email"), F.asc("subject")]).drop("_s")
    return once.withColumn("evidence_strength", F.lit("single_source"))


def timeline_counts(events: DataFrame, ts: str = "date", kind: str = "event_type") -> DataFrame:
    """Counts by type, and by year and month with sub-totals, from one pass."""
    keyed = events.select(F.col(kind).alias("event_type"), fd.period_key(F.col(ts), "year").alias("year"),
                          fd.period_key(F.col(ts), "month").alias("month"))
    return keyed.groupingSets(
        [["event_type"], ["year"], ["year", "month"], []], "event_type", "year", "month"
    ).agg(F.count(F.lit(1)).alias("events"))


def events_per_month(events: DataFrame, n: int = 30) -> DataFrame:
    """First ``n`` events of each month: the rendered timeline."""
    keyed = events.withColumn("month", fd.period_key(F.col("date"), "month"))
    return cap_per_group(keyed, ["month"], [F.asc("ts"), F.asc("contact_email"), F.asc("subject")], n, "rank")


def scenes(threads: Column, n: int = 10, width: int = 80) -> Column:
    """``date: subject`` of the first threads with a telling subject."""
    head = F.filter(F.slice(threads, 1, n), lambda t: F.length(t["subject"]) > 5)
    day = lambda t: F.coalesce(F.date_format(t["date"], "yyyy-MM-dd"), F.lit("?"))
    return F.transform(head, lambda t: F.concat(day(t), F.lit(": "), F.substring(t["subject"], 1, width)))


def cast_list(contacts: DataFrame, own: Sequence[str] = ()) -> DataFrame:
    """Relevant contacts with eras and narrative role."""
    enriched = F.coalesce(F.col("has_enrichment"), F.lit(False))
    kind, total = F.col("relationship_type"), F.col("total_emails")
    kept = contacts.filter(
        sc.is_relevant(enriched, total, kind, F.col("notable_context"), F.col("vault_page"))
        & ~F.col("email").isin(list(own))
    )
    name = F.coalesce(F.nullif("name", F.lit("")), F.substring_index("email", "@", 1))
    eras = fd.eras(F.col("first_contact"), F.col("last_contact"))
    return (
        kept.withColumn("name", name).withColumn("all_eras", eras)
        .withColumn("primary_era", F.get("all_eras", F.lit(0)))
        .withColumn("narrative_function", narrative_role(F.col("relationship_summary"), F.col("notable_context"), total, kind))
    )


def cast_counts(cast: DataFrame) -> DataFrame:
    """Contacts by era, by role and by both."""
    return cast.groupingSets(
        [["primary_era"], ["narrative_function"], ["primary_era", "narrative_function"]],
        "primary_era", "narrative_function",
    ).agg(F.count(F.lit(1)).alias("contacts"))


def cast_shown(cast: DataFrame, n: int = 30) -> DataFrame:
    """First ``n`` contacts per era and role, busiest first."""
    return cap_per_group(cast, ["primary_era", "narrative_function"], [F.desc("total_emails"), F.asc("email")], n, "rank")


