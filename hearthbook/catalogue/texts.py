"""Queries that classify, tag and clean texts."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from hearthbook.catalogue.base import derive, query, sql_list, sql_text, table
from hearthbook.functions import dates as fd, text as ft
from hearthbook.functions.text import unicode_words
from hearthbook.operators import classify as cl, reports, timeline as tl
from hearthbook.rulesets import chat, files as fr, mail as rm, ocr, timeline as rt

DOCS = "select doc_id, text, lang, source from {documents}"

# Rule sets in the invented language of the test texts, so that every branch is reached.
PROSE_EVENTS = [("first", r"eaupar|sching"), ("second", r"tionth|mentre"), ("third", r"ci[oó]n.*ado"), ("fourth", r"the|ung")]
PROSE_TOPICS = {"north": ["sch", "ung "], "south": ["eau", "ción"], "west": ["thing", "tion"], "east": ["queque"]}
PROSE_WEIGHTED = {
    "alpha": [(10, r"Th\w+"), (3, r"\bof\b"), (2, r"er{1,2}e")],
    "beta": [(9, r"Eau\w*|É\w+"), (5, r"leau?")],
    "gamma": [(8, r"Ung|SCH"), (2, r"ich\s"), (1, r"ung")],
    "delta": [(6, r"ci[oó]n"), (4, r"\w+ado[\s.,]")],
}
PROSE_FALLBACK = {"beta": [(4, r"e")], "omega": [(5, r"[xyz]")]}


def first_hit_sql(text: str, rules, default="null") -> str:
    return "case " + " ".join(
        f"when regexp_matches({text}, {sql_text(unicode_words(p))}) then {sql_text(label)}" for label, p in rules) + f" else {default} end"


def hits_sql(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, {sql_text(unicode_words(pattern))}))"


def score_sql(raw: str, low: str, patterns, as_written=None) -> str:
    terms = []
    for w, p in patterns:
        if as_written is None or w < as_written:
            terms.append(f"{hits_sql(low, p)} * {w}")
        else:
            terms.append(f"(case when {hits_sql(raw, p)} > 0 then {hits_sql(raw, p)} else {hits_sql(low, p)} end) * {w}")
    return " + ".join(terms)


def weighted_sql(rules, default, min_len, too_short=None, fallback=None, as_written=None, cols="doc_id") -> str:
    """Winner and score of every document under weighted rules, in SQL."""
    names = list(rules) + [n for n in (fallback or {}) if n not in rules]
    main = ", ".join(f"cast({score_sql('t', 'l', rules[n], as_written)} as bigint)" if n in rules else "0::bigint" for n in names)
    if fallback:
        extra = ", ".join(f"cast({score_sql('t', 'l', fallback[n])} as bigint)" if n in fallback else "0::bigint" for n in names)
        scores = f"(case when list_max([{main}]) < 3 then list_transform(list_zip([{main}], [{extra}]), lambda z: z[1] + z[2]) else [{main}] end)"
    else:
        scores = f"[{main}]"
    return f"""
with d as (select *, coalesce(text, '') as t, lower(coalesce(text, '')) as l from documents),
s as (select {cols}, length(regexp_replace(t, '^\\s+|\\s+$', '', 'g')) as n, {scores} as sc from d)
select {cols}, case when n < {min_len} then {sql_text(too_short or default)} when list_max(sc) = 0 then {sql_text(default)}
    else ({sql_list(names)})[list_position(sc, list_max(sc))] end as category,
  cast(case when n < {min_len} then 0 else list_max(sc) end as bigint) as score from s"""


@query("event_type_first_hit", "F15", f"""
select doc_id, {first_hit_sql("lower(case when contains(text, chr(10)) then regexp_replace(text, chr(10), ' ') else text || ' ' end)", rt.EVENT_RULES)} as event_type,
  {first_hit_sql("lower(text)", PROSE_EVENTS)} as prose_type from {{documents}}""")
def event_type_first_hit(spark, sf_dir):
    d, first = derive(spark, sf_dir, DOCS), F.substring_index("text", "\n", 1)
    return d.select("doc_id", cl.event_type(first, F.substr("text", F.length(first) + 2)).alias("event_type"),
                    cl.first_hit(F.col("text"), PROSE_EVENTS).alias("prose_type"))


_ROLE_TEXT = "lower(o_orderpriority || ' ' || case o_orderkey % 9 when 0 then 'Seed investor' when 1 then 'old mentor' when 2 then 'reporter' when 3 then 'fraud case' when 4 then 'my Sister' when 5 then 'bought two' when 6 then 'architect' when 7 then 'the mayor' else '' end)"


@query("narrative_role", "F16", f"""
select o_orderkey, case {" ".join(f"when exists (select 1 from (select unnest({sql_list(w)}) as k) x where contains({_ROLE_TEXT}, k)) then {sql_text(n)}" for n, w in rt.NARRATIVE_RULES)}
  when o_custkey % 200 >= 100 then 'core collaborator' when o_orderstatus in ('F') then 'collaborator' when o_orderstatus = 'O' then 'peer/witness' else 'supporting' end as role
from {{orders}}""")
def narrative_role(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    words = ["Seed investor", "old mentor", "reporter", "fraud case", "my Sister", "bought two", "architect", "the mayor"]
    notable = F.get(F.array(*[F.lit(w) for w in words]), (F.col("o_orderkey") % 9).cast("int"))
    kind = F.when(F.col("o_orderstatus") == "F", "contractor").when(F.col("o_orderstatus") == "O", "peer")
    return o.select("o_orderkey", cl.narrative_role(F.col("o_orderpriority"), notable, F.col("o_custkey") % 200, kind).alias("role"))


@query("contact_eras", "F13", """
select c, case when y1 is null then 'unknown' else coalesce(nullif(concat_ws('|', case when y1 <= 2014 then 'pre_brand' end,
  case when y1 <= 2016 and y2 >= 2014 then 'brand_launch' end, case when y1 <= 2019 and y2 >= 2016 then 'brand_commission' end,
  case when y1 <= 2022 and y2 >= 2019 then 'community_platform' end, case when y2 >= 2023 then 'art_park' end), ''), 'unknown') end as eras
from (select o_custkey as c, year(min(o_orderdate)) + 16 as y1, year(max(o_orderdate)) + 20 as y2 from {orders} group by 1) t""")
def contact_eras(spark, sf_dir):
    t = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c")).agg(
        (F.min("o_orderdate") + F.expr("interval 16 years")).alias("a"), (F.max("o_orderdate") + F.expr("interval 20 years")).alias("b"))
    return t.select("c", fd.eras(F.col("a"), F.col("b")).alias("eras"))


def edged(pattern: str) -> str:
    """Word edges next to letters of any script, for tests of existence only."""
    pattern = re.sub(r"\\b(?=\w)", lambda m: r"(?:^|[^\p{L}\p{N}_])", pattern)
    return pattern.replace(r"\b", r"(?:[^\p{L}\p{N}_]|$)")


def tags_sql(text: str, era: str, rules) -> str:
    themes = "[" + ", ".join(f"case when regexp_matches({text}, {sql_text(edged(unicode_words(p)))}) then {sql_list(t)} end" for p, t in rules) + "]"
    return f"array_to_string(list_sort(list_distinct(list_concat([{era}, 'press'], coalesce(nullif(flatten(list_filter({themes}, lambda x: x is not null)), []), ['profile'])))), '|')"


PROSE_THEMES = [(r"eau.*queque", ["long", "blue"]), (r"\bthe\b", ["plain"]), (r"sch\w+ung", ["cold", "long"])]
_ERA = "case " + " ".join(f"when y between {lo} and {hi} then {sql_text(n)}" for n, lo, hi in rt.PRESS_ERAS) + " else 'unknown-era' end"


@query("theme_tags", "F12 F14", f"""
select doc_id, {tags_sql("lower(text)", _ERA, rt.THEME_RULES)} as tags, {tags_sql("lower(text)", _ERA, PROSE_THEMES)} as prose_tags
from (select *, 2005 + doc_id % 27 as y from {{documents}}) d""")
def theme_tags(spark, sf_dir):
    d = derive(spark, sf_dir, DOCS)
    era = fd.era_tag(F.lit(2005) + F.col("doc_id") % 27)
    return d.select("doc_id", cl.theme_tags(F.col("text"), era).alias("tags"), cl.theme_tags(F.col("text"), era, PROSE_THEMES).alias("prose_tags"))


# -- timeline -----------------------------------------------------------------------------------

THREADS = """
select l_orderkey as msg_id, l_shipdate as ts, case l_linenumber % 3 when 0 then 'Re: ' when 1 then 'FW:  ' else '' end ||
  p_name || ' ' || case l_partkey % 6 when 0 then 'Invoice' when 1 then 'shipped' when 2 then 'interview' when 3 then 'booked' when 4 then 'hello' else 'won' end as subject,
  l_returnflag || ' note' as body, 's' || cast(l_suppkey as varchar(20)) || '@mail.example' as contact_email
from {lineitem} join {part} on l_partkey = p_partkey"""
_EVENTS = f"""
select * from (select *, cast(ts as date) as day, strftime(ts, '%Y-%m') as month, row_number() over (partition by cast(ts as date), trim(regexp_replace(lower(subject), '^((re|fwd|fw):\\s*)+', ''))
    order by ts, contact_email, subject) as rn
  from (select *, {first_hit_sql("lower(subject || ' ' || substring(body, 1, 200))", rt.EVENT_RULES)} as event_type from ({THREADS}) t) e where event_type is not null) d where rn = 1"""


def _events(spark, sf_dir):
    return tl.timeline_events(derive(spark, sf_dir, THREADS, ("lineitem",)))


@query("timeline_events", "F15 F56 W5 L3", f"select epoch_us(ts) as ts, event_type, subject, contact_email from ({_EVENTS}) e")
def timeline_events(spark, sf_dir):
    return _events(spark, sf_dir).select("ts", "event_type", "subject", "contact_email")


@query("timeline_counts", "A8", f"""
select event_type, year, month, count(*) as events from (select event_type, strftime(ts, '%Y') as year, month from ({_EVENTS}) e) k
group by grouping sets ((event_type), (year), (year, month), ())""")
def timeline_counts(spark, sf_dir):
    return tl.timeline_counts(_events(spark, sf_dir))


@query("events_per_month", "W7", f"""
select month, rank, contact_email, subject from (select *, row_number() over (partition by month order by ts, contact_email, subject) as rank from ({_EVENTS}) e) r where rank <= 30""")
def events_per_month(spark, sf_dir):
    return tl.events_per_month(_events(spark, sf_dir)).select("month", "rank", "contact_email", "subject")


CAST = """
select 'c' || cast(o_custkey as varchar(20)) || '@mail.example' as email, case when o_custkey % 3 = 0 then 'N' || cast(o_custkey as varchar(20)) else '' end as name,
  count(*) * 6 as total_emails, min(o_orderdate) as first_contact, max(o_orderdate) as last_contact, o_custkey % 4 <> 0 as has_enrichment,
  case o_custkey % 6 when 0 then 'press' when 1 then 'contractor' when 2 then 'vendor' when 3 then 'family' else 'peer' end as relationship_type,
  case when o_custkey % 10 = 0 then 'met the mayor' end as notable_context, case when o_custkey % 8 = 0 then 'fabricator' else '' end as relationship_summary,
  case when o_custkey % 15 = 0 then 'page' end as vault_page
from {orders} group by o_custkey"""
_CAST = f"""
select email, coalesce(nullif(name, ''), split_part(email, '@', 1)) as name, total_emails, case when year(first_contact) <= 2014 then 'pre_brand' else 'unknown' end as primary_era,
 case when contains(txt, 'mayor') then 'civic partner' when contains(txt, 'fabricat') then 'builder' when total_emails >= 100 then 'core collaborator'
   when relationship_type in ('collaborator', 'contractor') then 'collaborator' when relationship_type = 'peer' then 'peer/witness' else 'supporting' end as narrative_function
from (select *, lower(relationship_summary || ' ' || coalesce(notable_context, '')) as txt from ({CAST}) c) c
where (has_enrichment or total_emails >= 50) and (relationship_type in ('press', 'family') or total_emails >= 50 or notable_context is not null or vault_page is not null
  or (relationship_type = 'contractor' and total_emails >= 20)) and email <> 'c1@mail.example'"""


def _fix_order(sql):
    # The civic group comes after the builder group.
    return sql.replace("case when contains(txt, 'mayor') then 'civic partner' when contains(txt, 'fabricat') then 'builder'",
                       "case when contains(txt, 'fabricat') then 'builder' when contains(txt, 'mayor') then 'civic partner'")


_CAST = _fix_order(_CAST)


def _cast(spark, sf_dir):
    return tl.cast_list(derive(spark, sf_dir, CAST), ["c1@mail.example"])


@query("cast_list", "P8 F13 F16", _CAST)
def cast_list(spark, sf_dir):
    return _cast(spark, sf_dir).select("email", "name", "total_emails", "primary_era", "narrative_function")


@query("cast_counts", "A9", f"""
select primary_era, narrative_function, count(*) as contacts from ({_CAST}) c
group by grouping sets ((primary_era), (narrative_function), (primary_era, narrative_function))""")
def cast_counts(spark, sf_dir):
    return tl.cast_counts(_cast(spark, sf_dir))


@query("cast_shown", "W7", f"""
select email, primary_era, narrative_function, rank from (select *, row_number() over (partition by primary_era, narrative_function order by total_emails desc, email) as rank from ({_CAST}) c) r where rank <= 30""")
def cast_shown(spark, sf_dir):
    return tl.cast_shown(_cast(spark, sf_dir)).select("email", "primary_era", "narrative_function", "rank")


@query("contact_scenes", "F55", f"""
with o as (select contact_email, ts, msg_id, subject, row_number() over (partition by contact_email order by ts, msg_id, subject) as rn from ({THREADS}) t)
select contact_email, string_agg(strftime(ts, '%Y-%m-%d') || ': ' || substring(subject, 1, 80), '|' order by rn) as scenes from o where rn <= 10 and length(subject) > 5 group by 1""")
def contact_scenes(spark, sf_dir):
    from hearthbook.operators.ordering import cap_per_group

    first = cap_per_group(derive(spark, sf_dir, THREADS), ["contact_email"], [F.asc("ts"), F.asc("msg_id"), F.asc("subject")], 10, "rn")
    rows = first.groupBy("contact_email").agg(F.array_sort(F.collect_list(F.struct("rn", F.col("ts").alias("date"), "subject"))).alias("threads"))
    return rows.select("contact_email", tl.scenes(F.col("threads")).alias("scenes"))


# -- classification -----------------------------------------------------------------------------

def topics_sql(text: str, rules, default="uncategorized") -> str:
    parts = ", ".join(
        f"case when exists (select 1 from (select unnest({sql_list(w)}) as k) x where contains({text}, k)) then {sql_text(n)} end" for n, w in rules.items())
    return f"coalesce(nullif(list_filter([{parts}], lambda x: x is not null), []), [{sql_text(default)}])"


_SKIP_PROSE = ["^the\\b", "queque$"]
TITLES = "select conv_id, max(case when turn = 0 then text end) as title, count(*) as message_count from {conversations} group by conv_id"
_TOPIC = f"""
select conv_id, message_count, unnest({topics_sql("lower(title)", PROSE_TOPICS)}) as domain from ({TITLES}) t
where message_count >= 3 and not regexp_matches(lower(title), '(?:^the\\b)|(?:queque$)')"""


@query("chat_topics", "F17 P12", f"select conv_id, message_count, domain from ({_TOPIC}) t")
def chat_topics(spark, sf_dir):
    from hearthbook.operators.chat import topic_index

    return topic_index(derive(spark, sf_dir, TITLES), PROSE_TOPICS, _SKIP_PROSE).select("conv_id", "message_count", "domain")


@query("chat_domain_stats", "A18", f"select domain, count(*) as conversations, cast(sum(message_count) as bigint) as messages from ({_TOPIC}) t group by domain")
def chat_domain_stats(spark, sf_dir):
    from hearthbook.operators.chat import domain_stats, topic_index

    return domain_stats(topic_index(derive(spark, sf_dir, TITLES), PROSE_TOPICS, _SKIP_PROSE))


@query("text_domains", "F17", f"""
select doc_id, array_to_string({topics_sql("lower(text)", chat.DOMAIN_RULES)}, '|') as domains,
  array_to_string({topics_sql("lower(text)", PROSE_TOPICS)}, '|') as prose_domains from {{documents}}""")
def text_domains(spark, sf_dir):
    return derive(spark, sf_dir, DOCS).select("doc_id", cl.multi_label(F.col("text"), chat.DOMAIN_RULES).alias("domains"),
                                              cl.multi_label(F.col("text"), PROSE_TOPICS).alias("prose_domains"))


def _graded(df):
    return df.select("doc_id", "category", "score")


@query("coarse_category", "F18 W10", weighted_sql(cl.flat_rules(ocr.COARSE_RULES), "Other", 10))
def coarse_category(spark, sf_dir):
    return _graded(cl.coarse_class(derive(spark, sf_dir, DOCS), "text"))


@query("refined_category", "F19 W10", weighted_sql(cl.grouped_rules(ocr.REFINED_RULES), "Other", 10))
def refined_category(spark, sf_dir):
    return _graded(cl.refined_class(derive(spark, sf_dir, DOCS), "text"))


@query("detailed_category", "F20 W10", weighted_sql(ocr.DETAILED_RULES, "Uncategorized", 5, "Unreadable", ocr.FALLBACK_RULES, 8))
def detailed_category(spark, sf_dir):
    return _graded(cl.detailed_class(derive(spark, sf_dir, DOCS), "text"))


@query("prose_category", "F20 W10", weighted_sql(PROSE_WEIGHTED, "Uncategorized", 5, "Unreadable", PROSE_FALLBACK, 8))
def prose_category(spark, sf_dir):
    return _graded(cl.weighted_class(derive(spark, sf_dir, DOCS), "text", PROSE_WEIGHTED, "Uncategorized", 5, "Unreadable",
                                     PROSE_FALLBACK, as_written=8))


def keyword_sql(text: str, rules, default: str, min_score=2.0) -> str:
    names = list(rules)
    sc = "[" + ", ".join(
        f"(select count(*) from (select unnest({sql_list(w)}) as k) x where contains({text}, k)) * {float(g)}::double" for g, w in rules.values()) + "]"
    return f"""select doc_id, list_max(sc) as score, case when list_max(sc) >= {min_score} then ({sql_list(names)})[list_position(sc, list_max(sc))] else {default} end as category
from (select *, {sc} as sc from (select *, 'file' || doc_id || ' ' || lower(text) as fulltext from documents) d) e"""


PROSE_KEYWORDS = {"one": (1.0, ["eau", "the ", "sch"]), "two": (1.5, ["queque", "thing"]), "three": (2.0, ["ción", "license"])}


@query("document_category", "F21", keyword_sql("fulltext", fr.DOCUMENT_CATEGORIES, "lang"))
def document_category(spark, sf_dir):
    d = derive(spark, sf_dir, DOCS)
    named = F.concat(F.lit("file"), "doc_id", F.lit(" "), "text")
    return cl.keyword_class(d, named, F.col("lang")).select("doc_id", "score", "category")


@query("prose_document_category", "F21", keyword_sql("fulltext", PROSE_KEYWORDS, "lang"))
def prose_document_category(spark, sf_dir):
    d = derive(spark, sf_dir, DOCS)
    named = F.concat(F.lit("file"), "doc_id", F.lit(" "), "text")
    return cl.keyword_class(d, named, F.col("lang"), PROSE_KEYWORDS).select("doc_id", "score", "category")


# -- reports ------------------------------------------------------------------------------------

_PROSE = weighted_sql(PROSE_WEIGHTED, "Uncategorized", 5, "Unreadable", PROSE_FALLBACK, 8, cols="doc_id, source, lang")


def _prose(spark, sf_dir):
    return cl.weighted_class(derive(spark, sf_dir, DOCS), "text", PROSE_WEIGHTED, "Uncategorized", 5, "Unreadable", PROSE_FALLBACK, as_written=8)


@query("category_share", "A10", f"select category, count(*) as n, round(count(*) * 100 / (sum(count(*)) over ())::double, 1) as percent from ({_PROSE}) p group by category")
def category_share(spark, sf_dir):
    return reports.category_share(_prose(spark, sf_dir))


_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM"]


@query("month_pivot", "A11", f"""
select strftime(o_orderdate, '%Y-%m') as month, {", ".join(f'count(*) filter (where o_orderpriority = {sql_text(p)}) as "{p}"' for p in _PRIORITIES)},
  count(*) filter (where o_orderpriority not in ({", ".join(sql_text(p) for p in _PRIORITIES)})) as "Other", count(*) as "Total" from {{orders}} group by 1""")
def month_pivot(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("month", fd.period_key(F.col("o_orderdate"), "month"))
    return reports.month_pivot(o, "month", "o_orderpriority", names=_PRIORITIES)


@query("top_month_pivot", "A11 L2", """
with top as (select event_type, row_number() over (order by count(*) desc, event_type) as k from {events} group by 1)
select strftime(ts, '%Y-%m-%d') as month, count(*) filter (where k <= 2) as top2, count(*) filter (where k > 2) as "Other", count(*) as "Total" from {events} join top using (event_type) group by 1""")
def top_month_pivot(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("month", fd.period_key(F.col("ts"), "day"))
    p = reports.month_pivot(e, "month", "event_type", top=2)
    names = [c for c in p.columns if c not in ("month", "Other", "Total")]
    return p.select("month", sum((F.col(f"`{n}`") for n in names), F.lit(0)).alias("top2"), "Other", "Total")


_FAMILIES = {"alpha": "greek", "beta": "greek", "gamma": "runic", "omega": "runic"}


@query("family_totals", "A34", f"""
select family, category, count(*) as n from (select category, case when category in ('alpha', 'beta') then 'greek' when category in ('gamma', 'omega') then 'runic' end as family from ({_PROSE}) p) f
where family is not null group by grouping sets ((family), (family, category))""")
def family_totals(spark, sf_dir):
    return reports.family_totals(_prose(spark, sf_dir), "category", _FAMILIES)


_TICKER_TEXT = "text || case when doc_id % 3 = 0 then ' $AB' when doc_id % 5 = 0 then ' buy $XYZ now $AB' else ' $q1' end"


@query("ticker_counts", "A12", f"""
select ticker, count(*) as mentions from (select unnest(regexp_extract_all({_TICKER_TEXT}, '\\$([A-Z]{{2,5}})\\b', 1)) as ticker from documents) t group by 1 order by 2 desc, 1 limit 30""")
def ticker_counts(spark, sf_dir):
    d = derive(spark, sf_dir, DOCS).withColumn("text", F.concat("text", F.when(F.col("doc_id") % 3 == 0, " $AB").when(
        F.col("doc_id") % 5 == 0, " buy $XYZ now $AB").otherwise(" $q1")))
    return reports.ticker_counts(d, "text")


@query("search_queries", "F58", """
select doc_id, coalesce(nullif(trim(regexp_extract(t, 'Q\\.?\\s*(.{3,60}?)\\s*(G\\s*@|&|All\\s+Images)', 1)), ''), '(could not extract)') as query
from (select doc_id, text || ' Q. ' || source || ' ' || lang || ' G @' as t from {documents}) d""")
def search_queries(spark, sf_dir):
    t = F.concat("text", F.lit(" Q. "), "source", F.lit(" "), "lang", F.lit(" G @"))
    return reports.search_queries(table(spark, sf_dir, "documents").withColumn("text", t), "text").select("doc_id", "query")


@query("style_fingerprint", "A30", r"""
with t as (select source, text, len(regexp_extract_all(text, '[\p{L}\p{N}'']+')) as w, greatest(len(regexp_extract_all(text || ' ', '[.!?]+\s')), 1) as s,
    len(regexp_extract_all(text, '[,;:()!?—-]')) as m, length(text) as c, regexp_matches(ltrim(text, chr(32)), '^\p{Lu}') as cap from documents),
p as (select source, len(regexp_extract_all(x, '[\p{L}\p{N}'']+')) as n from (select source, unnest(regexp_split_to_array(text, '\n+')) as x from documents) q)
select source, count(*) as texts, round(sum(w) / sum(s)::double, 2) as words_per_sentence, round(sum(m) * 100 / greatest(sum(c), 1)::double, 3) as marks_per_100_chars,
  round(count(*) filter (where cap) / count(*)::double, 3) as capital_start, median(c) as median_chars,
  (select median(n) from p where p.source = t.source and n > 0) as median_paragraph_words from t group by source""")
def style_fingerprint(spark, sf_dir):
    return reports.style_fingerprint(derive(spark, sf_dir, DOCS), "source", "text")


# -- cleaning -----------------------------------------------------------------------------------

_T = "coalesce(text, '')"


@query("slugs_and_names", "F4 F5", r"""
select doc_id, substring(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(h), '^\s+|\s+$', '', 'g'), '[^\p{L}\p{N}_\s-]', '', 'g'), '[\s_]+', '-', 'g'), '-+', '-', 'g'), '-'), 1, 60) as url_slug,
  trim(regexp_replace(regexp_replace(lower(h), '[^a-zA-Z0-9_-]', '-', 'g'), '-+', '-', 'g'), '-') as tag_slug,
  trim(regexp_replace(lower(h), '[^a-z0-9]+', '-', 'g'), '-') as id_slug,
  coalesce(nullif(substring(trim(regexp_replace(replace(replace(h, '/', '-'), '\', '-'), '[<>:"|?*]', '', 'g'), '. '), 1, 200), ''), 'Untitled') as safe_name,
  case when length(n) > 120 then case when contains(substring(n, 1, 120), ' ') then regexp_replace(substring(n, 1, 120), ' [^ ]*$', '') else substring(n, 1, 120) end else n end as headline
from (select *, regexp_replace(h, '[<>:"/\\|?*]', '', 'g') as n from (select doc_id, replace(text, chr(10), ' / ') as h from documents) d) e""")
def slugs_and_names(spark, sf_dir):
    d = derive(spark, sf_dir, DOCS).withColumn("h", F.replace("text", F.lit("\n"), F.lit(" / ")))
    h = F.col("h")
    return d.select("doc_id", ft.slugify(h).alias("url_slug"), ft.slugify(h, "tag").alias("tag_slug"), ft.slugify(h, "id").alias("id_slug"),
                    ft.safe_name(h).alias("safe_name"), ft.headline_name(h).alias("headline"))


@query("address_file_names", "F5", """
select email, case when length(p) > 100 or regexp_matches(email, '[/\\\\ ]') then substring(p, 1, 40) || '_' || substring(md5(email), 1, 12) else p end as file
from (select email, replace(replace(replace(replace(replace(email, '@', '_at_'), '.', '_'), '/', '_'), '\\', '_'), ' ', '_') as p
  from (select case when c_custkey % 5 = 0 then repeat('x', cast(c_custkey % 130 as integer)) || '/' else '' end || c_name || '@mail.example' as email from {customer}) c) d""")
def address_file_names(spark, sf_dir):
    c = derive(spark, sf_dir, "select case when c_custkey % 5 = 0 then repeat('x', cast(c_custkey % 130 as int)) || '/' else '' end || c_name || '@mail.example' as email from {customer}")
    return c.select("email", ft.address_file_name(F.col("email")).alias("file"))


@query("clean_lines", "F22", r"""
select doc_id, coalesce(array_to_string(list_filter(string_split(t, chr(10)), lambda x: trim(x) <> ''
  and not regexp_full_match(regexp_replace(x, '^\s+|\s+$', '', 'g'), '(?i)(?:\d{1,2}:\d{2}\s*[=\-]?\s*[ao]?[lti!]*\s*(?:5G\+?|LTE|4G|Wi-?Fi)\s*[@&GC()\s]*)|(?:\b[aA]{2}\s*[@&]\s*)|(?:[A-Z]\s+Q\s+[GCS©()\s]+)|(?:[A-Z]\s+[CQ]\s+[©()\s]+\s*[pP@]?\s*)|(?:\s*(ft|Home)\s+(Friends\s+)?(Inbox\s+)?Profile\s*)|(?:\s*©?\s*\d*\s*)')), chr(10)), '') as cleaned
from (select doc_id, '9:41 LTE @' || chr(10) || text || chr(10) || chr(10) || ' ' || doc_id || chr(10) || 'Home Friends Profile' as t from documents) d""")
def clean_lines(spark, sf_dir):
    t = F.concat(F.lit("9:41 LTE @\n"), "text", F.lit("\n\n "), "doc_id", F.lit("\nHome Friends Profile"))
    return derive(spark, sf_dir, DOCS).select("doc_id", ft.clean_lines(t).alias("cleaned"))


@query("previews", "F44 P14", """
select doc_id, case when length(text) > 100 then substring(text, 1, 100) || '...' else text end as short,
  trim(replace(replace(substring(text, 1, 120), chr(10), ' '), '|', '/')) || case when length(text) > 120 then '...' else '' end as line,
  length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) >= 100 as long_enough from documents""")
def previews(spark, sf_dir):
    t = F.col("text")
    return derive(spark, sf_dir, DOCS).select("doc_id", ft.preview(t, 100).alias("short"), ft.one_line_preview(t, 120).alias("line"),
                                              ft.min_length(t, 100).alias("long_enough"))


@query("paragraphs", "F57", """
select doc_id, count(*) as parts, count(*) filter (where length(x) < 80 and not regexp_matches(x, '[."'']$')) as headings
from (select doc_id, regexp_replace(unnest(string_split(text, chr(10))), '^\\s+|\\s+$', '', 'g') as x from documents) d where x <> '' group by doc_id""")
def paragraphs(spark, sf_dir):
    p = derive(spark, sf_dir, DOCS).select("doc_id", F.inline(ft.paragraphs(F.col("text"))))
    return p.groupBy("doc_id").agg(F.count(F.lit(1)).alias("parts"), F.count_if("is_heading").alias("headings"))


@query("page_text", "F6", r"""
select page_id, replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<style\b.*?</style\s*>', '', 'g'),
   '(?is)<script\b.*?</script\s*>', '', 'g'), '(?s)<!--.*?-->', '', 'g'),
   '(?i)</(p|div|tr|li|h1|h2|h3|h4|br)\s*>|<br\s*/>', chr(10), 'g'), '(?s)<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') as body from pages""")
def page_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", ft.html_to_text(F.col("html")).alias("body"))


_MAIL_BODY = """text || chr(10) || case doc_id % 4 when 0 then '> quoted' || chr(10) || chr(10) || 'after' || chr(10) || 'On Mon, A wrote:' || chr(10) || 'old'
  when 1 then '--- Original Message ---' || chr(10) || 'old' when 2 then 'From: a' || chr(10) || chr(10) || 'Sent: b' || chr(10) || 'old'
  else 'From: here on' || chr(10) || 'we go' end || chr(10) || '--' || chr(10) || 'call 555-0100' || chr(10) || 'Director of ' || source || chr(10) || '+1 212 555 0199'"""
BODY_SQL = "select doc_id, source, " + _MAIL_BODY.replace("chr(10)", "'\n'") + " as body from {documents}"


_STRIP = r"regexp_replace({0}, '^[\s\x0B]+|[\s\x0B]+$', '', 'g')"
_BODIES = "(select doc_id, source, " + _MAIL_BODY + " as body from documents)"


@query("reply_stripping", "F7", f"""
with l as (select doc_id, string_split(body, chr(10)) as ls, list_transform(string_split(body, chr(10)), lambda x: {_STRIP.format('x')}) as st from {_BODIES} b),
m as (select *, list_filter(range(1, len(st) + 1), lambda i: regexp_matches(st[i], '^On .+ wrote:$') or regexp_matches(st[i], '(?i)^-{{3,}}\\s*Original Message\\s*-{{3,}}')
  or (regexp_matches(st[i], '^From:\\s+') and len(list_filter(st[i + 1:i + 3], lambda y: regexp_matches(y, '^(Sent|Date|To|Subject):\\s+'))) > 0))[1] as stop from l),
k as (select doc_id, coalesce(ls[1:stop - 1], ls) as ls, coalesce(st[1:stop - 1], st) as st from m)
select doc_id, {_STRIP.format("coalesce(array_to_string(list_filter(ls, lambda x, i: not (starts_with(st[i], '>') or (st[i] = '' and starts_with(coalesce(list_filter(st[1:i], lambda y: y <> '')[-1], ''), '>')))), chr(10)), '')")} as body from k""")
def reply_stripping(spark, sf_dir):
    d = derive(spark, sf_dir, BODY_SQL)
    return d.select("doc_id", ft.strip_replies(F.col("body")).alias("body"))


_TITLE = "(?i)^(?:" + "|".join(rm.TITLE_WORDS) + r")[\p{L}\p{N}_\s,/&-]*"


@query("signatures", "F8", f"""
with l as (select doc_id, body, string_split({_STRIP.format('body')}, chr(10)) as ls from {_BODIES} b),
a as (select *, case when len(ls) > 15 then array_to_string(ls[-15:], chr(10)) else body end as area, list_filter(range(1, len(ls) + 1), lambda i: list_contains({sql_list(rm.SIGNATURE_MARKS)}, {_STRIP.format('ls[i]')}))[1] as mark from l)
select doc_id, {_STRIP.format(f"list_filter(regexp_extract_all(area, {sql_text(rm.SIGNATURE_PHONE)}), lambda p: length(regexp_replace(p, '[^0-9]', '', 'g')) >= 7)[1]")} as phone,
  nullif({_STRIP.format(f"regexp_extract(list_filter(list_transform(ls[mark + 1:], lambda x: {_STRIP.format('x')}), lambda x: regexp_matches(x, {sql_text(_TITLE)}) and not regexp_matches(x, {sql_text(rm.SIGNATURE_PHONE)}) and not contains(x, '@'))[1], {sql_text(_TITLE)})")}, '') as title from a""")
def signatures(spark, sf_dir):
    d = derive(spark, sf_dir, BODY_SQL)
    return d.withColumn("s", ft.signature(F.col("body"))).select("doc_id", "s.phone", "s.title")


@query("article_dates", "F9", """
select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as day, case o_orderkey % 6 when 5 then 'soon' else strftime(case when o_orderkey % 6 = 4 then date_trunc('month', o_orderdate) else o_orderdate end, '%Y-%m-%d') end as parsed,
  epoch_us(o_orderdate) + 3600000000 * 9 + 60000000 * 5 as mailed from {orders}""")
def article_dates(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    d = F.col("o_orderdate")
    written = F.get(F.array(F.date_format(d, "MMMM d, yyyy"), F.date_format(d, "yyyy/MM/dd"), F.date_format(d, "M/d/yyyy"), F.date_format(d, "d MMM yyyy"),
                            F.date_format(d, "MMMM yyyy"), F.lit("soon")), (F.col("o_orderkey") % 6).cast("int"))
    mailed = fd.mail_date(F.concat(F.lit("Tue, "), F.date_format(d, "d MMM yyyy"), F.lit(" 09:05:00 -0700")))
    return o.select("o_orderkey", fd.epoch_day(F.unix_timestamp(d.cast("timestamp"))).alias("day"), fd.article_date(written).alias("parsed"), mailed.alias("mailed"))


@query("year_and_byline", "F11 F49", """
select doc_id, coalesce(nullif(regexp_extract(l, '(20\\d{2}|19\\d{2})', 1), ''), nullif(regexp_extract(c, '(20\\d{2}|19\\d{2})', 1), ''), 'unknown') as year, source as author,
  case when doc_id % 2 = 0 then lang else '' end as date
from (select *, case when doc_id % 3 = 0 then 'in 19' || lpad(cast(doc_id % 100 as varchar), 2, '0') else 'x' end as l, case when doc_id % 3 = 1 then 'at 2007' else '' end as c from documents) d""")
def year_and_byline(spark, sf_dir):
    d = derive(spark, sf_dir, DOCS)
    link = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("in 19"), F.lpad((F.col("doc_id") % 100).cast("string"), 2, "0"))).otherwise("x")
    ctx = F.when(F.col("doc_id") % 3 == 1, "at 2007").otherwise("")
    by = F.concat(F.lit("By  "), "source", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" · "), "lang")).otherwise(""))
    s = ft.split_byline(by)
    return d.select("doc_id", ft.find_year(link, ctx).alias("year"), s["author"].alias("author"), s["date"].alias("date"))


@query("set_operations", "U4 U5 U7", r"""
select a.doc_id, cast((select count(*) from (select distinct unnest(regexp_extract_all(lower(a.text), '[\p{L}\p{N}_]+')) as w) x
   where length(w) >= 5 and list_contains(regexp_extract_all(lower(b.text), '[\p{L}\p{N}_]+'), w)) as bigint) as shared,
  cast((case when a.lang in ('en', 'fr') then 1 else 0 end) as bigint) as wanted, case when a.source = 'src1' then a.lang else a.source || '|' || a.lang end as rest
from documents a join documents b on b.doc_id = a.doc_id + 1""")
def set_operations(spark, sf_dir):
    a = derive(spark, sf_dir, DOCS)
    b = a.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other"))
    langs = F.array(F.lit("en"), F.lit("fr"))
    return a.join(b, "doc_id").select("doc_id", ft.word_overlap(F.col("text"), F.col("other")).alias("shared"),
                                      ft.set_overlap(F.array("lang"), langs).alias("wanted"), ft.minus_noise(F.array("source", "lang"), ["src1"]).alias("rest"))


@query("yaml_rendering", "F53 F41", """
select doc_id, '["' || source || '", "' || replace(left(text, 10), '"', '\\"') || '"]' as items, '---' || chr(10) || 'lang: ' || lang || chr(10) || 'size: ' || n_chars || chr(10) || '---' as front from {documents}""")
def yaml_rendering(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", ft.yaml_list(F.array("source", F.substring("text", 1, 10))).alias("items"),
                    ft.frontmatter({"lang": F.col("lang"), "size": F.col("n_chars")}).alias("front"))
