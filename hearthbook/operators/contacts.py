"""Contact tables: fan-out of mail to contacts, roll-up, survivorship merge, lookups, statistics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from hearthbook.functions import mail as fm
from hearthbook.functions.text import signature, strip_replies
from hearthbook.operators.ordering import cap_per_group, char_budget, stratified_sample
from hearthbook.rulesets import mail


def known_not_self(df: DataFrame, addr: str, known: DataFrame, own: Sequence[str]) -> DataFrame:
    """Rows whose address is a known contact and not one of the owner's."""
    wanted = known.select(F.lower(F.trim("email")).alias(addr)).distinct()
    return df.filter(~F.col(addr).isin(list(own))).join(wanted, addr, "left_semi")


def participants(sender: Column, recipients: Column, own: Sequence[str]) -> Column:
    """Distinct addresses of a message except the owner's."""
    everyone = F.array_union(F.array(sender), F.transform(recipients, lambda r: r["addr"]))
    return F.array_except(everyone, F.array(*[F.lit(a) for a in own]))


def contact_messages(messages: DataFrame, known: DataFrame, own: Sequence[str]) -> DataFrame:
    """One row per (message, known contact) with direction, body and signature finds."""
    human = messages.filter(~fm.is_automated(F.col("sender"), F.col("list_unsub"), F.col("precedence")))
    long_enough = F.length("body") > mail.MIN_BODY_CHARS
    own_list = list(own)
    prepared = human.withColumn("_clean", F.when(long_enough, strip_replies(F.col("body"))))
    prepared = prepared.withColumn("_sig", F.when(long_enough, signature(F.col("body"), mark_first=True)))
    named = F.concat(
        F.array(F.struct(F.col("sender_name").alias("name"), F.col("sender").alias("addr"))),
        F.transform("recipients", lambda r: F.struct(r["name"].alias("name"), r["addr"].alias("addr"))),
    )
    fanned = prepared.select(
        "msg_id", "ts", "subject", "sender", "_clean", "_sig", named.alias("_named"),
        F.explode(participants(F.col("sender"), F.col("recipients"), own_list)).alias("contact"),
    )
    kept = known_not_self(fanned, "contact", known, own_list)
    side = fm.direction(F.col("sender"), F.col("contact"), own_list)
    return kept.select(
        "contact", "msg_id", "ts", "subject", side.alias("direction"),
        F.when(side.isin("from", "to"), F.coalesce("_clean", F.lit(""))).otherwise("").alias("body"),
        F.when(side == "from", F.col("_sig")["phone"]).alias("phone_sig"),
        F.when(side == "from", F.col("_sig")["title"]).alias("title_sig"),
        F.array_distinct(F.transform(
            F.filter("_named", lambda x: (x["addr"] == F.col("contact")) & (F.length(x["name"]) > 1)
                     & ~F.startswith(x["name"], F.lit("=?"))), lambda x: x["name"])).alias("names"),
    )


def contact_counts(df: DataFrame, contact: str = "contact", direction: str = "direction", ts: str = "ts") -> DataFrame:
    """Mail counts by direction and the first and last contact."""
    side = F.col(direction)
    return df.groupBy(contact).agg(
        F.count(F.lit(1)).alias("total_emails"),
        F.count_if(side == "from").alias("emails_from"),
        F.count_if(side == "to").alias("emails_to"),
        F.count_if(side == "cc").alias("emails_cc"),
        F.min(ts).alias("first_contact"),
        F.max(ts).alias("last_contact"),
    )


def first_subjects(df: DataFrame, contact: str, subject: str, order: Sequence[str], n: int = 30) -> DataFrame:
    """First ``n`` distinct subjects of each contact in mail order, with their rank."""
    known = df.filter(F.coalesce(F.col(subject), F.lit("")) != "")
    at = known.groupBy(contact, subject).agg(F.min(F.struct(*order)).alias("_at"))
    return cap_per_group(at, [contact], [F.asc("_at")], n, "rank").drop("_at")


def distinct_values(df: DataFrame, contact: str, value: str) -> DataFrame:
    """Sorted array of the distinct values of a contact, e.g. phones found in signatures."""
    pairs = df.filter(F.col(value).isNotNull()).groupBy(contact, value).agg(F.lit(1).alias("_one"))
    return pairs.groupBy(contact).agg(F.array_sort(F.collect_list(value)).alias(value))


def contact_rollup(cm: DataFrame, account: str = "") -> DataFrame:
    """Contact bundles: counts, names, signature data, subjects and sampled threads."""
    counts = contact_counts(cm)
    names = cm.select("contact", F.explode("names").alias("name")).distinct()
    names = names.groupBy("contact").agg(
        F.transform(F.array_sort(F.collect_list(F.struct((-F.length("name")).alias("n"), "name"))),
                    lambda x: x["name"]).alias("display_names"))
    phones = distinct_values(cm, "contact", "phone_sig").withColumnRenamed("phone_sig", "phones_from_sig")
    titles = distinct_values(cm, "contact", "title_sig").withColumnRenamed("title_sig", "titles_from_sig")
    subjects = first_subjects(cm, "contact", "subject", ["ts", "msg_id"])
    subjects = subjects.groupBy("contact").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "subject"))), lambda x: x["subject"])
        .alias("unique_subjects"))
    with_body = cm.filter(F.length("body") > mail.MIN_BODY_CHARS).withColumn("_when", F.struct("ts", "msg_id"))
    by_day = F.to_date("ts")
    sampled = stratified_sample(with_body, ["contact"], "_when", "body", slice_by=by_day).drop("pos")
    fitted = char_budget(sampled, ["contact"], "_when", "body", mail.MAX_BUNDLE_CHARS, slice_by=by_day)
    threads = fitted.groupBy("contact").agg(
        F.count(F.lit(1)).alias("emails_sampled"),
        F.transform(
            F.array_sort(F.collect_list(F.struct("_when", "subject", "direction", "body"))),
            lambda x: F.struct(x["_when"]["ts"].alias("date"), x["subject"].alias("subject"),
                               x["direction"].alias("direction"), x["body"].alias("body_snippet")),
        ).alias("threads"))
    out = counts
    for part in (names, phones, titles, subjects, threads):
        out = out.join(part, "contact", "left")
    return out.withColumn("source_account", F.lit(account)).withColumnRenamed("contact", "email")


# -- lookups ------------------------------------------------------------------------------------


def with_address_book(bundles: DataFrame, book: DataFrame) -> DataFrame:
    return bundles.join(book.withColumn("gc_match", F.lit(True)), "email", "left").fillna({"gc_match": False})


def with_crm(bundles: DataFrame, crm: DataFrame) -> DataFrame:
    return bundles.join(crm.withColumn("crm_match", F.lit(True)), "email", "left").fillna({"crm_match": False})


def with_enrichment(bundles: DataFrame, results: DataFrame, a: int = 10, b: int = 3) -> DataFrame:
    """Attach enrichment and tier; ``enrichment_state`` tells matched, missing and not wanted apart."""
    found = results.withColumn("_found", F.lit(True))
    joined = bundles.withColumn("email", F.lower(F.trim("email"))).join(found, "email", "left")
    tier = fm.volume_tier(F.col("total_emails"), a, b)
    state = (
        F.when(F.col("_found"), "enriched").when(tier == "C", "metadata_only").otherwise("unmatched")
    )
    return joined.withColumn("enrichment_tier", tier).withColumn("enrichment_state", state).drop("_found")


def best_values(df: DataFrame) -> DataFrame:
    """Best name, phone, organisation, title and place; address book before CRM before mail."""
    def first_item(c: str) -> Column:
        return F.get(F.col(c), F.lit(0))
    has_city = F.col("gc_city").isNotNull()
    return (
        df.withColumn("best_name", F.coalesce("gc_name", "crm_name", first_item("display_names"), F.lit("")))
        .withColumn("best_phone", F.coalesce("gc_phone", "crm_phone", first_item("phones_from_sig")))
        .withColumn("best_org", F.col("gc_org"))
        .withColumn("best_title", F.coalesce("gc_title", first_item("titles_from_sig")))
        .withColumn("best_city", F.coalesce("gc_city", "crm_city"))
        .withColumn("best_region", F.when(has_city, F.col("gc_region"))
                    .when(F.col("crm_match"), F.col("crm_state")).otherwise(F.col("gc_region")))
    )


# -- merging ------------------------------------------------------------------------------------


def first_filled(field: Column, rank: Column) -> Column:
    """Value of ``field`` in the best-ranked row that has one; combines on the map side."""
    value = F.nullif(field, F.lit("")) if field is not None else field
    return F.min(F.when(value.isNotNull(), F.struct(rank.alias("r"), value.alias("v"))))["v"]


def merge_accounts(
    rows: DataFrame, key: str = "email", order: str = "pos", filled: Sequence[str] = tuple(mail.FILLED_FIELDS),
    carried: Sequence[str] = (),
) -> DataFrame:
    """One row per address: the first enriched row wins, blanks come from the others in order.

    ``filled`` are taken from the first row that has them, ``carried`` from the winning row as is.
    """
    enriched = F.coalesce(F.col("has_enrichment").cast("boolean"), F.lit(False))
    rank = F.struct((~enriched).alias("plain"), F.col(order).alias("at"))
    norm = rows.withColumn(key, F.lower(F.trim(key))).filter(F.coalesce(F.col(key), F.lit("")) != "")
    account = F.col("source_account")
    return norm.groupBy(key).agg(
        *[first_filled(F.col(c), rank).alias(c) for c in filled],
        *[F.min(F.struct(rank.alias("r"), F.col(c).alias("v")))["v"].alias(c) for c in carried],
        F.sum(F.col("total_emails").try_cast("bigint")).alias("total_emails"),
        F.min("first_contact").alias("first_contact"),
        F.max("last_contact").alias("last_contact"),
        F.array_join(F.array_sort(F.collect_set(account)), ", ").alias("source_accounts"),
        F.max(enriched).alias("has_enrichment"),
        F.count(F.lit(1)).alias("merged_rows"),
    )


def merge_graph_contacts(bundles: DataFrame, order: str = "pos") -> DataFrame:
    """Nodes for the graph: summed mail, all accounts, enrichment of the first row that has one."""
    enriched = F.col("relationship_type").isNotNull()
    at = F.col(order)
    norm = bundles.withColumn("email", F.lower("email"))

    def first_of(c: str, cond: Column | None = None) -> Column:
        s = F.struct(at.alias("at"), F.col(c).alias("v"))
        return F.min(F.when(cond, s) if cond is not None else s)["v"].alias(c)

    return norm.groupBy("email").agg(
        F.sum("total_emails").alias("total_emails"),
        F.array_sort(F.collect_set("source_account")).alias("source_accounts"),
        first_of("relationship_type", enriched), first_of("org", F.coalesce(F.col("org"), F.lit("")) != ""),
        first_of("name"), F.min("first_contact").alias("first_contact"), F.max("last_contact").alias("last_contact"),
    )


def union_addresses(sources: Sequence[DataFrame], own: Sequence[str] = ()) -> DataFrame:
    """Distinct addresses of all sources minus the owner's, with the first source that had each."""
    ranked = [s.select(F.lower(F.trim("email")).alias("email"), F.lit(i).alias("source"))
              for i, s in enumerate(sources, 1)]
    every = reduce(DataFrame.unionByName, ranked)
    kept = every.filter(F.contains("email", F.lit("@")) & ~F.col("email").isin(list(own)))
    return kept.groupBy("email").agg(F.min("source").alias("source"))


def source_contributions(addresses: DataFrame) -> DataFrame:
    """How many new addresses each source brought."""
    return addresses.groupBy("source").agg(F.count(F.lit(1)).alias("new_addresses"))


def union_wide(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of tables with different columns; missing ones are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def not_done(df: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key has not been handled yet."""
    return df.join(done.select(*keys).distinct(), list(keys), "left_anti")


def multi_account(df: DataFrame, strength: str = "relationship_strength", k: int = 20) -> DataFrame:
    """Contacts that appear in several accounts, strongest first."""
    several = df.filter(F.contains("source_accounts", F.lit(",")))
    return several.orderBy(F.desc(strength), F.asc("email")).limit(k)


# -- statistics ---------------------------------------------------------------------------------


def strength_distribution(df: DataFrame, strength: str, thresholds: Sequence[int] = (75, 50, 25, 10, 0)) -> DataFrame:
    """Contacts at or above each threshold, in one pass."""
    counted = df.agg(*[F.count_if(F.col(strength) >= t).alias(f"t{t}") for t in thresholds])
    pairs = F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"t{t}").alias("contacts")) for t in thresholds])
    return counted.select(F.inline(pairs))


def coverage(df: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """Number of rows for which each named condition holds, next to the total."""
    return df.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(k) for k, c in flags.items()])


def enrichment_stats(df: DataFrame) -> DataFrame:
    return df.groupBy("enrichment_state").agg(F.count(F.lit(1)).alias("contacts"))


def tier_counts(df: DataFrame, tier: str) -> DataFrame:
    return df.groupBy(tier).agg(F.count(F.lit(1)).alias("contacts"))
