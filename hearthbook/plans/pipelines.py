"""Whole pipelines as lazy DataFrame compositions; nothing runs until a sink asks for rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from hearthbook.functions import dates as fd, mail as fm, render, scores as sc
from hearthbook.functions.names import match_status, page_name
from hearthbook.operators import (
    chat as oc, classify as cl, contacts as ct, entities as oe, graph as og, lint, linkage as ol, media as om,
    ordering as oo, press as op, reports, sessions as os_, social as so, timeline as tl,
)
from hearthbook.rulesets import mail as rm
from hearthbook.session import materialise


# -- contacts -----------------------------------------------------------------------------------


def match_pages(bundles: DataFrame, names: DataFrame) -> DataFrame:
    """Best people page per contact over all its display names. ``names``: page, name, rank."""
    shown = bundles.select("email", F.posexplode("display_names").alias("_at", "shown"))
    best = ol.fuzzy_match(shown.select("shown"), names, "shown", "name", "page", "rank")
    ranked = shown.join(best, "shown").groupBy("email").agg(
        F.min(F.struct((-F.col("score")).alias("s"), "_at", "matched_page")).alias("_b"))
    score = -F.col("_b.s")
    found = ranked.select("email", F.when(score >= 60, F.col("_b.matched_page")).alias("vault_page"),
                          score.alias("vault_match_score"), match_status(score).alias("vault_match_status"))
    return bundles.join(found, "email", "left").fillna({"vault_match_score": 0.0, "vault_match_status": "no_match"})


def review_rows(matched: DataFrame) -> DataFrame:
    """Proposed matches a person should confirm."""
    wanted = matched.filter(F.col("vault_match_status") == "needs_review")
    return wanted.select("email", F.array_join("display_names", ", ").alias("display_names"), F.col("vault_page").alias("proposed_match"),
                         F.col("vault_match_score").alias("match_score"), "total_emails", F.lit("").alias("action"))


def contact_360(messages: DataFrame, known: DataFrame, own: Sequence[str], book: DataFrame, crm: DataFrame,
                page_names: DataFrame, results: DataFrame, as_of: str, account: str = "") -> DataFrame:
    """Mail to master contact rows of one account."""
    bundles = ct.contact_rollup(ct.contact_messages(messages, known, own), account)
    matched = match_pages(bundles, page_names)
    valued = ct.best_values(ct.with_crm(ct.with_address_book(matched, book), crm))
    return master_rows(ct.with_enrichment(valued, results), as_of)


def master_rows(df: DataFrame, as_of: str) -> DataFrame:
    """Master contact columns; strength and gap are computed for ``as_of``."""
    last = F.col("last_contact").cast("timestamp_ntz")
    strength = sc.relationship_strength(F.col("total_emails"), last, F.col("emails_from"), F.col("emails_to"), as_of)
    joined = lambda c: F.array_join(F.coalesce(c, F.array().cast("array<string>")), ", ")
    ok = (F.col("enrichment_state") == "enriched") & F.col("error").isNull()
    named = (
        df.withColumn("name", F.coalesce(F.nullif("best_name", F.lit("")), F.get("display_names", F.lit(0)), F.lit("")))
        .withColumn("phone", F.col("best_phone")).withColumn("organization", F.col("best_org"))
        .withColumn("role_title", F.coalesce(F.nullif("role_title", F.lit("")), "best_title"))
        .withColumn("city", F.col("best_city")).withColumn("state", F.col("best_region"))
        .withColumn("relationship_strength", strength).withColumn("communication_gap_days", fd.gap_days(last, as_of))
        .withColumn("key_topics", joined("key_topics")).withColumn("projects_in_common", joined("projects_in_common"))
        .withColumn("collector_type", F.col("crm_collector_type")).withColumn("collector_priority", F.col("crm_priority"))
        .withColumn("total_purchases", F.col("crm_net_sales")).withColumn("products_purchased", F.col("crm_products"))
        .withColumn("has_enrichment", ok)
    )
    return named.select(*rm.MASTER_COLUMNS)


def merge_masters(masters: Sequence[DataFrame], recompute_for: str | None = None) -> DataFrame:
    """Master rows of all accounts merged by address.

    Totals are summed. With ``recompute_for`` the counts behind the strength are summed as well and
    strength and gap are computed anew; without it they stay those of the winning row.
    """
    rows = ct.union_wide([m.withColumn("pos", F.lit(i)) for i, m in enumerate(masters)])
    carried = ["relationship_strength", "communication_gap_days", "emails_from", "emails_to", "vault_match_status",
               "collector_priority", "products_purchased", "gc_birthday", "enrichment_tier"]
    merged = ct.merge_accounts(rows, carried=carried)
    if recompute_for is None:
        return merged
    sums = rows.withColumn("email", F.lower(F.trim("email"))).groupBy("email").agg(
        F.sum("emails_from").alias("emails_from"), F.sum("emails_to").alias("emails_to"))
    last = F.col("last_contact").cast("timestamp_ntz")
    fresh = merged.drop("emails_from", "emails_to").join(sums, "email")
    strength = sc.relationship_strength(F.col("total_emails"), last, F.col("emails_from"), F.col("emails_to"), recompute_for)
    return fresh.withColumn("relationship_strength", strength).withColumn("communication_gap_days", fd.gap_days(last, recompute_for))


def page_changes(contacts: DataFrame, pages: DataFrame, as_of: str, today: str, min_strength: int = 50) -> DataFrame:
    """(page, action, content) for people pages to update or create; done pages yield nothing.

    ``contacts`` are enriched bundles with the best values and the page match, ``pages``: page, content.
    """
    last = F.col("last_contact").cast("timestamp_ntz")
    strength = sc.relationship_strength(F.col("total_emails"), last, F.col("emails_from"), F.col("emails_to"), as_of)
    ok = (F.col("enrichment_state") == "enriched") & F.col("error").isNull() & ~fm.is_service(F.col("email"))
    shown = F.coalesce(F.nullif("best_name", F.lit("")), F.get("display_names", F.lit(0)))
    staged = contacts.withColumn("name", shown).withColumn("first_contact", F.col("first_contact").cast("timestamp_ntz")).withColumn("last_contact", last)
    staged = staged.withColumn("action", sc.page_action(F.col("vault_match_status"), ok, F.col("total_emails"), strength, F.col("relationship_type"), min_strength))
    page = F.when(F.col("action") == "update", F.col("vault_page")).otherwise(page_name(F.col("name")))
    joined = staged.withColumn("page", page).filter(F.col("page").isNotNull() & (F.col("action") != "none"))
    joined = joined.join(pages.select("page", F.col("content").alias("_old")), "page", "left")
    updated = render.person_update(F.col("_old"), render.update_section(), F.col("email"), today)
    content = F.when(F.col("action") == "update", updated).otherwise(render.person_page(today))
    fresh = F.when(F.col("action") == "update", F.col("_old").isNotNull() & (updated != F.col("_old"))).otherwise(F.col("_old").isNull())
    return oo.dedup_first(joined.filter(fresh).select("page", "action", "email", content.alias("content")), ["page"], [F.asc("email")]).drop("email")


# -- graph, timeline, cast ----------------------------------------------------------------------


def message_table(messages: DataFrame, known: DataFrame, own: Sequence[str]) -> DataFrame:
    """Contact messages, stored: bundles, graph and timeline all read them, and the mailbox is parsed once."""
    return materialise(ct.contact_messages(messages, known, own), "messages")


def relationship_graph(bundles: DataFrame, messages: DataFrame | None = None) -> dict[str, DataFrame]:
    """Nodes, significant edges, connectors and statistics.

    ``messages`` (contact, subject) give every shared subject; without them the graph rests on the first subjects that the
    bundles carry.
    """
    nodes = ct.merge_graph_contacts(bundles).withColumnRenamed("email", "id")
    if messages is None:
        subjects = bundles.select(F.lower("email").alias("contact"), F.explode("unique_subjects").alias("subject"))
    else:
        subjects = messages.select(F.lower("contact").alias("contact"), "subject")
    pairs = og.cooccurrence_pairs(og.subject_groups(subjects, "subject", "contact"))
    edges = materialise(og.significant(og.edge_weights(pairs), nodes), "edges")
    sampled = edges.join(og.edge_samples(pairs), ["source", "target"])
    return {"nodes": nodes, "edges": sampled, "connectors": og.connectors(edges, nodes), "stats": og.graph_stats(nodes, edges)}


def timeline(bundles: DataFrame | None, own: Sequence[str] = (), messages: DataFrame | None = None) -> dict[str, DataFrame]:
    """Dated events, their counts and the rows of the rendered timeline.

    ``messages`` (contact, ts, subject, direction, body) give the events of all mail; without them only the sampled threads
    of the bundles are read.
    """
    if messages is None:
        threads = bundles.select(F.col("email").alias("contact_email"), F.explode("threads").alias("t"))
        flat = threads.select("contact_email", F.col("t.date").cast("timestamp_ntz").alias("ts"), "t.subject", "t.direction",
                              F.coalesce("t.body_snippet", F.lit("")).alias("body"))
    else:
        flat = messages.select(F.col("contact").alias("contact_email"), F.col("ts").cast("timestamp_ntz").alias("ts"), "subject", "direction",
                               F.coalesce("body", F.lit("")).alias("body"))
    events = tl.timeline_events(flat.filter(~F.col("contact_email").isin(list(own))))
    return {"events": events, "counts": tl.timeline_counts(events), "shown": tl.events_per_month(events)}


def cast(contacts: DataFrame, own: Sequence[str] = ()) -> dict[str, DataFrame]:
    listed = tl.cast_list(contacts, own)
    return {"cast": listed, "counts": tl.cast_counts(listed), "shown": tl.cast_shown(listed)}


# -- social and chat ----------------------------------------------------------------------------


def social_ranking(messages: DataFrame, owner: str, pages: DataFrame | None = None, **words) -> dict[str, DataFrame]:
    """Best contacts of a message archive with tiers and tag counts. Threads of the same people are one.

    ``words`` replace the word lists of the scores (professional, warmth, followup, tags).
    """
    few = messages.filter((F.size("participants") > 0) & (F.size("participants") <= 3))
    present = None
    if pages is not None:
        people = few.select("name", F.explode("participants").alias("title")).distinct()
        present = people.join(pages.select("title").distinct(), "title", "left_semi").select("name").distinct()
    scored = so.contact_score(few, "name", F.col("author") == owner, "body", ["thread_id", "pos"], "ts", present, **words)
    ranked = so.contact_ranking(scored, "name")
    return {"scores": scored, "ranking": ranked, "tags": so.tag_counts(ranked)}


def chat_index(conversations: DataFrame) -> dict[str, DataFrame]:
    """Chat summaries by topic domain."""
    topics = oc.topic_index(oc.summarise_chat(oc.current_path(conversations)))
    return {"topics": topics, "stats": oc.domain_stats(topics)}


# -- texts --------------------------------------------------------------------------------------


def ocr_knowledge(texts: DataFrame, merge: DataFrame, as_of: str) -> dict[str, DataFrame]:
    """Categories, entities, profiles and scores of OCR texts. ``texts``: stem, month, text."""
    graded = cl.detailed_class(texts, "text")
    wide = oe.entities_wide(graded, "text", "category")
    named = oe.named_entities(wide, ["stem", "month", "category"], merge)
    profiles = oe.entity_score(oe.entity_profiles(named, "month", "category"), as_of)
    note = render.text_note(F.col("stem"), F.col("month"), F.col("category"), F.col("score"), F.col("text"))
    return {
        "entries": graded, "share": reports.category_share(graded), "profiles": profiles,
        "values": oe.entity_values(named, "month", "category"), "tiers": oe.score_tiers(profiles),
        "notes": wide.select("stem", "month", "category", note.alias("note")),
    }


def media_organisation(media: DataFrame, gap_minutes: int = 120, min_photos: int = 3) -> dict[str, DataFrame]:
    """Categories, target names and events of media files. ``media``: path, name, ext, width, height, has_camera, taken_at, lat, lon."""
    sorted_ = om.with_category(media).withColumn("month", fd.period_key(F.col("taken_at"), "month"))
    target = sorted_.withColumn("dest_dir", F.concat_ws("/", "category", "month"))
    named = oo.unique_destinations(target, "dest_dir", "name", [F.asc("taken_at"), F.asc("path")], F.to_date("taken_at"))
    shots = sorted_.filter(F.col("category").isin("Photos", "Videos"))
    sessions = os_.sessionize(shots, "taken_at", gap_minutes * 60)
    video = F.col("category") == "Videos"
    events = os_.number_events(os_.event_summary(sessions, "taken_at", (), min_photos, ~video, video, "lat", "lon"))
    events = events.withColumn("folder", os_.event_folder(F.col("event_no"), F.col("session_start"), F.col("session_end")))
    return {"placed": named, "stats": om.media_stats(sorted_), "gps": om.gps_coverage(sorted_), "events": events,
            "members": sessions.join(events.select("session_start", "event_no"), "session_start")}


def document_placement(files: DataFrame, known: DataFrame, people: DataFrame, companies: DataFrame, root: str = "",
                       min_score: float = 2.0) -> DataFrame:
    """Manifest of every file and its new place."""
    placed = om.place(files, known, people, companies, root, min_score)
    depth = F.xxhash64("path")
    return om.placement_manifest(placed, [F.asc(depth), F.asc("path")], F.shiftright(depth, 52))


# -- press, picking, notes ----------------------------------------------------------------------


def press_archive(articles: DataFrame, notes: DataFrame, min_chars: int = 50) -> DataFrame:
    """Action and note for every parsed article. ``articles``: article_id, year, outlet, headline, author, date, url, body_md."""
    long_enough = articles.filter(F.length(F.coalesce("body_md", F.lit(""))) >= min_chars)
    named = op.publisher_names(long_enough).withColumn("publisher", F.col("display_name"))
    titled = named.withColumn("headline", F.coalesce(F.nullif("headline", F.lit("")), F.lit("Untitled")))
    tagged = op.tag_articles(titled.withColumn("_t", F.concat_ws(" ", "headline", "body_md")), "_t", "year")
    note = op.article_note(F.col("url"), F.col("author"), F.col("publisher"), F.col("date"), F.col("tags"), F.col("body_md"))
    return op.integrate_articles(tagged.withColumn("note", note), notes)


def hero_selection(files: DataFrame, works: DataFrame, selections: DataFrame) -> dict[str, DataFrame]:
    """Ranked candidates of every work, the state of its selection and totals."""
    candidates = om.hero_candidates(files)
    names = F.when(F.coalesce("folder", F.lit("")) == "", F.col("name")).otherwise(F.concat_ws("/", "folder", "name"))
    have = candidates.select(F.col("work_id"), names.alias("filename"))
    status = om.apply_selections(selections, works, have)
    return {"ranked": oo.rank_candidates(candidates, "work_id", "score", "name"), "status": status, "stats": om.selection_stats(status)}


def vault_lint(notes: DataFrame, as_of: str, naming: Mapping[str, str] | None = None) -> DataFrame:
    """All findings of all checks in one table."""
    links = lint.note_links(notes)
    findings = [
        lint.broken_links(links, notes), lint.stubs(notes), lint.duplicates(notes), lint.orphans(notes, links),
        lint.missing_frontmatter(notes), lint.status_mismatch(notes), lint.naming(notes, dict(naming or {})),
        lint.concepts(links, notes), lint.stale(notes, as_of), lint.underlinked(notes, links),
    ]
    out = findings[0]
    for f in findings[1:]:
        out = out.unionByName(f)
    return out


