"""Queries on entities, names, dictionaries and the co-occurrence graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthbook.catalogue.base import derive, query, sql_list, sql_text, table
from hearthbook.functions import names as fn, text as ft
from hearthbook.operators import entities as oe, graph as og, linkage as ol
from hearthbook.rulesets import entities as ent, files as fr
from hearthbook.session import materialise

DOCS = "select doc_id, text, lang, source from {documents}"

# Texts with one of each entity appended, so that every extractor has work on the given rows.
EXTRA = (
    "case doc_id % 5 when 0 then ' pay $1,250.50 or $3K to @shop_one by March 3, 2024 at www.site.example' "
    "when 1 then ' call (212) 555-0123 or mail Anna.Bell@Mail.example on 2024/05/06' "
    "when 2 then ' go to 12 Old Mill Road, Suite 5 with $AAPL and $TSLA' "
    "when 3 then ' you need to water the tall plants today' else ' see https://a.example/b?c=1 and shop.art/new' end")
RICH = f"select doc_id, text || {EXTRA} as text, lang, source from {{documents}}"


def _cleaned_sql(rich: str = RICH) -> str:
    """Same text with blank lines and lone-number lines removed, as the extractors see it."""
    furniture = r"(?i)\s*©?\s*\d*\s*"
    return f"""select doc_id, source, lang, coalesce(array_to_string(list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g') <> ''
  and not regexp_full_match(regexp_replace(x, '^\\s+|\\s+$', '', 'g'), {sql_text(furniture)})), chr(10)), '') as text from ({rich}) r"""


def dedup_sql(found: str) -> str:
    """First spelling of each value per text, order kept."""
    return f"""select doc_id, value, row_number() over (partition by doc_id order by p) - 1 as pos from (
  select doc_id, value, p, row_number() over (partition by doc_id, lower(value) order by p) as k from (
    select doc_id, trim(v[p]) as value, p from (select doc_id, v, unnest(range(1, len(v) + 1)) as p from ({found}) f) g) h where length(value) > 1) i where k = 1"""


def matches_sql(pattern: str, group: int = 0) -> str:
    p = ft.unicode_words(pattern)
    return f"select doc_id, regexp_extract_all(text, {sql_text(p)}, {group}) as v from ({_cleaned_sql()}) c"


def _long(spark, sf_dir, kind):
    d = derive(spark, sf_dir, RICH)
    return oe.entities_long(d, "doc_id", "text", kinds=[kind]).select("doc_id", "value", "pos")


def _entity_query(name, covers, kind, sql):
    @query(name, covers, sql)
    def run(spark, sf_dir):
        return _long(spark, sf_dir, kind)
    return run


_entity_query("entity_emails", "F23b F24 F22", "emails", dedup_sql(matches_sql(ent.EMAIL)))
_entity_query("entity_prices", "F23f F24", "prices", dedup_sql(matches_sql(ent.PRICE)))
_entity_query("entity_dates", "F23e F24", "dates_mentioned", dedup_sql(matches_sql(ent.DATE)))
_entity_query("entity_addresses", "F23g F24", "addresses", dedup_sql(matches_sql(ent.ADDRESS)))
_entity_query("entity_tickers", "F23h F24", "tickers", dedup_sql(
    f"select doc_id, list_transform(v, lambda x: '$' || x) as v from ({matches_sql(ent.TICKER, 1)}) m"))
_entity_query("entity_handles", "F23d F24", "handles", dedup_sql(
    f"select doc_id, list_transform(list_filter(v, lambda x: not list_contains({sql_list(ent.HANDLE_SKIP)}, lower(x))), lambda x: '@' || x) as v from ({matches_sql(ent.HANDLE, 1)}) m"))
_entity_query("entity_urls", "F23c F24", "urls", dedup_sql(
    f"select doc_id, list_filter(v, lambda u: length(u) >= 6 and not list_contains({sql_list(ent.URL_NOISE)}, lower(split_part(split_part(u, '/', 1), '?', 1)))) as v from ({matches_sql(ent.URL)}) m"))
_entity_query("entity_todos", "F23i F24", "todos", f"select * from ({dedup_sql(matches_sql(ent.TODO))}) t where pos < 10")

# The phone pattern looks around itself: SQL tries every start behind a non-digit and keeps the
# leftmost of overlapping finds.
_PHONE = r"(?:\+?1[\s.-]?)?(?:\(\d{3}\)|\d{3})[\s.\-]?\d{3}[\s.\-]?\d{4}"
_entity_query("entity_phones", "F23a", "phones", f"""
with s as (select doc_id, text, unnest(range(1, length(text) + 1)) as i from ({_cleaned_sql()}) c where regexp_matches(text, '[0-9]{{3}}')),
f as (select doc_id, i, regexp_extract(substring(text, i, 30), '^({_PHONE})(?:[^0-9]|$)', 1) as value from s
  where substring(text, i, 1) in ('+', '(', '0', '1', '2', '3', '4', '5', '6', '7', '8', '9') and (i = 1 or not regexp_matches(substring(text, i - 1, 1), '[0-9]'))),
k as (select *, coalesce(max(i + length(value)) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as busy from f where value <> '')
select doc_id, value, row_number() over (partition by doc_id order by i) - 1 as pos from k where i >= busy""")

# Lines of screens around the given texts: a chat partner above, people, shops and quotations below.
SCREEN = (
    "case doc_id % 7 when 0 then 'Liked by annlee and others' when 1 then 'BILLED TO: Anna Bell' when 2 then 'Harbour Light Gallery' || {nl} || 'ordered from Blue Door bakery today' "
    "when 3 then '\"This is a quoted passage of some forty letters\"' when 4 then 'Mary Poppins called' || {nl} || '@shop_one Following' when 5 then 'Followed by Zoë' else 'nothing here' end")
SCREENS = ("select doc_id, case doc_id % 3 when 0 then 'Anna Bell' || {nl} when 1 then 'Send Message' || {nl} || 'Bob Stone Junior' || {nl} else '' end || coalesce(text, '') || {nl} || "
           + SCREEN + " as text, source, lang from {documents}")
SCREENS_SPARK, SCREENS_DUCK = SCREENS.replace("{nl}", "'\\n'"), SCREENS.replace("{nl}", "chr(10)").replace("{documents}", "documents")


def groups_sql(pattern: str, n: int) -> str:
    """Groups of every match, stripped, those that took part, in text order; \\w of any script."""
    p = ft.unicode_words(pattern)
    each = ", ".join(f"regexp_extract_all(text, {sql_text(p)}, {g})" for g in range(1, n + 1))
    return f"""list_filter(list_transform(flatten(list_transform(list_zip({each}), lambda z: [{', '.join(f'z[{g}]' for g in range(1, n + 1))}])),
  lambda x: regexp_replace(coalesce(x, ''), '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')"""


def _screen_kind(name, covers, kind, found, category=None, cap=None):
    sql = dedup_sql(f"select doc_id, {found} as v from ({_cleaned_sql(SCREENS_DUCK)}) c")

    @query(name, covers, sql if cap is None else f"select * from ({sql}) q where pos < {cap}")
    def run(spark, sf_dir):
        d = derive(spark, sf_dir, SCREENS_SPARK)
        if category:
            d = d.withColumn("category", F.lit(category))
        return oe.entities_long(d, "doc_id", "text", "category" if category else None, [kind]).select("doc_id", "value", "pos")
    return run


_NOISY = f"not list_contains({sql_list(ent.NAME_NOISE)}, split_part(lower(x), ' ', 1)) and length(x) > 2 and not regexp_matches(x, '^({'|'.join(ent.PROVIDER_HANDLES)})')"
_HANDLES = f"""list_transform(list_filter(regexp_extract_all(text, {sql_text(ft.unicode_words(ent.HANDLE))}, 1), lambda h: not list_contains({sql_list(ent.HANDLE_SKIP)}, lower(h))), lambda h: '@' || h)"""
# each handle once in its first spelling, the first five
_FIVE = f"list_filter({_HANDLES}, lambda h, i: list_position(list_transform({_HANDLES}, lambda y: lower(y)), lower(h)) = i)[1:5]"
_screen_kind("entity_people", "F23m F24", "people", f"list_filter(list_concat(list_filter({groups_sql(ent.PERSON, 5)}, lambda x: length(x) > 2), {_FIVE}), lambda x: {_NOISY})", cap=15)
_screen_kind("entity_services", "F23l F24", "services", f"""list_filter({groups_sql(ent.BUSINESS, 3)}, lambda x: length(x) > 2 and not list_contains({sql_list(ent.SERVICE_NOISE)}, lower(x)) and not regexp_matches(x, '^[0-9]'))""", cap=10)
_screen_kind("entity_quotes", "F23j F24", "quotes", f"regexp_extract_all(text, {sql_text(ent.QUOTE)}, 1)", cap=5)
_screen_kind("entity_contacts", "F23n", "contacts", f"""list_filter(list_transform(string_split(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10))[1:3], lambda l: regexp_extract(l, {sql_text(ent.CONTACT_NAME)}, 1)),
  lambda x: length(x) > 3 and not list_contains({sql_list(ent.NAME_NOISE)}, lower(x)))[1:1]""", category="WhatsApp")

# Kinds that need look-around or category hints run on every text without a twin; fixtures test them.
@query("entity_mixed_kinds", "F23j F23k F23l F23m F23n A17")
def entity_mixed_kinds(spark, sf_dir):
    d = derive(spark, sf_dir, RICH).withColumn("category", F.when(F.col("lang") == "en", "Inspirational / Quotes").when(
        F.col("lang") == "fr", "Food / Restaurants").otherwise("WhatsApp"))
    long = oe.entities_long(d, "doc_id", "text", "category", ["quotes", "products", "services", "people", "contacts"])
    return oe.entity_totals(long, "doc_id")


_KINDS = {
    "emails": dedup_sql(matches_sql(ent.EMAIL)), "prices": dedup_sql(matches_sql(ent.PRICE)),
    "tickers": dedup_sql(f"select doc_id, list_transform(v, lambda x: '$' || x) as v from ({matches_sql(ent.TICKER, 1)}) m"),
}
_LONG = " union all ".join(f"select doc_id, '{k}' as kind, value, pos from ({s}) {k}" for k, s in _KINDS.items())


def _three(spark, sf_dir):
    return oe.entities_long(derive(spark, sf_dir, RICH), "doc_id", "text", kinds=list(_KINDS))


@query("entity_totals", "A17", f"select kind, count(*) as total, count(distinct doc_id) as texts from ({_LONG}) l group by kind")
def entity_totals(spark, sf_dir):
    return oe.entity_totals(_three(spark, sf_dir), "doc_id")


@query("entity_index", "A33", f"""
select value, count(*) as sources, array_to_string(list_sort(list(doc_id))[1:5], '|') as first_sources, greatest(count(*) - 5, 0) as more
from (select distinct value, doc_id from ({_LONG}) l where kind = 'tickers') d group by value""")
def entity_index(spark, sf_dir):
    return oe.entity_index(_three(spark, sf_dir), "doc_id", "tickers")


# -- profiles and scores: orders mention their customer ----------------------------------------

MENTIONS = """
select o_orderkey as doc_id, case when o_custkey % 4 = 0 then 'service' when o_custkey % 4 = 1 then 'product' else 'person' end as kind,
  'Entity ' || cast(o_custkey as varchar(20)) as name, substring(cast(o_orderdate as varchar(30)), 1, 7) as month, o_orderpriority as category,
  case when o_orderkey % 3 = 0 then 'e' || cast(o_custkey as varchar(20)) || '@mail.example' end as email, case when o_orderkey % 5 = 0 then 'p' || cast(o_orderkey % 2 as varchar(3)) end as phone,
  case when o_orderkey % 2 = 0 then '@h' || cast(o_custkey as varchar(20)) end as handle, case when o_orderkey % 11 = 0 then 'site.example' end as url from {orders}"""
_REL = ["1-URGENT", "2-HIGH"]
_PROFILE = f"""
select kind, name, count(*) as n, min(month) as first_seen, max(month) as last_seen, count(distinct month) as months, count(distinct category) as categories,
  count(distinct category) filter (where category in ('1-URGENT', '2-HIGH')) as wanted, count(distinct email) as emails, count(distinct phone) as phones, count(distinct handle) as handles, count(distinct url) as urls
from ({MENTIONS}) m group by kind, name"""
_SCORED = f"""
select *, recency + repetition + contactability + relevance + confidence as total from (
select kind, name, n, last_seen,
  cast(floor(greatest(0.0, least(5.0, 5.0 - (date_diff('day', cast(last_seen || '-01' as date), date '2001-11-01') / 30) / 3))) as bigint) as recency,
  cast(case when n >= 10 then 5 when n >= 5 then 4 when n >= 3 then 3 when n >= 2 then 2 else 1 end as bigint) as repetition,
  cast(least(5, (case when emails > 0 then 2 else 0 end) + (case when phones > 0 then 2 else 0 end) + (case when handles > 0 then 1 else 0 end) + (case when urls > 0 then 1 else 0 end)) as bigint) as contactability,
  cast(least(5, wanted * 2 + case when n > 1 then 1 else 0 end) as bigint) as relevance,
  cast(greatest(1, least(5, 3 + (case when n >= 3 then 1 else 0 end) + (case when emails > 0 or phones > 0 then 1 else 0 end) - (case when months = 1 and n = 1 then 1 else 0 end))) as bigint) as confidence
from ({_PROFILE}) p) q"""
_TIER = "case when total >= 20 then '20-25 Immediate' when total >= 15 then '15-19 Research' when total >= 10 then '10-14 Archive' else '0-9 Ignore' end"


def _profiles(spark, sf_dir):
    m = derive(spark, sf_dir, MENTIONS)
    one = lambda c: F.when(F.col(c).isNotNull(), F.array(c)).otherwise(F.array().cast("array<string>"))
    rows = m.withColumn("emails", one("email")).withColumn("phones", one("phone")).withColumn("handles", one("handle")).withColumn("urls", one("url"))
    return oe.entity_profiles(rows, "month", "category", _REL)


@query("entity_profiles", "A16", f"select kind, name, n, first_seen, last_seen, months, categories, emails, phones, handles, urls from ({_PROFILE}) p")
def entity_profiles(spark, sf_dir):
    p = _profiles(spark, sf_dir)
    return p.select("kind", "name", "n", "first_seen", "last_seen", "months", "categories", "emails", "phones", "handles", "urls")


@query("entity_score25", "F30", f"select kind, name, recency, repetition, contactability, relevance, confidence, total, {_TIER} as tier from ({_SCORED}) s")
def entity_score25(spark, sf_dir):
    s = oe.entity_score(_profiles(spark, sf_dir), "2001-11-01")
    return s.select("kind", "name", "recency", "repetition", "contactability", "relevance", "confidence", "total", "tier")


@query("score_tiers", "A29", f"""
select kind, {", ".join(f'count(*) filter (where {_TIER} = {sql_text(t)}) as "{t}"' for t in ["20-25 Immediate", "15-19 Research", "10-14 Archive", "0-9 Ignore"])} from ({_SCORED}) s group by kind""")
def score_tiers(spark, sf_dir):
    return oe.score_tiers(oe.entity_score(_profiles(spark, sf_dir), "2001-11-01"))


_MERGE = {"small ring": "Ring Works", "red widget": "_ORG:Widget House", "blue bolt": "Bolt", "old bolt": "Bolt"}


@query("alias_canonicalise", "J14", f"""
select p_partkey, case when v like '\\_ORG:%' escape '\\' and k = 'person' then 'service' else k end as kind, coalesce(replace(v, '_ORG:', ''), p_name) as name
from (select p_partkey, p_name, case when p_partkey % 2 = 0 then 'person' else 'product' end as k, case lower(trim(p_name)) {" ".join(f"when {sql_text(a)} then {sql_text(b)}" for a, b in _MERGE.items())} end as v from {{part}}) p""")
def alias_canonicalise(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 2 == 0, "person").otherwise("product").alias("kind"))
    return oe.canonicalise(p, oe.merge_table(spark, _MERGE)).select("p_partkey", "kind", "name")


_NAMES = """
select doc_id, case doc_id % 6 when 0 then text when 1 then upper(text) when 2 then '@' || source || '.com' when 3 then cast(doc_id as varchar(20)) when 4 then 'Add' else source || ' Labs' end as name,
  case when doc_id % 2 = 0 then 'service' else 'product' end as kind from {documents}"""
_WORDS = "len(list_filter(regexp_split_to_array(name, '\\s+'), lambda w: w <> ''))"


@query("name_quality", "P19 P20 P21", f"""
select doc_id, good, good and words >= 2 as contact, good and (words >= 2 or list_contains({sql_list(fr.COMPANY_SUFFIXES)}, low)) as company,
  list_contains({sql_list(ent.PERSON_BLOCKLIST + ent.HANDLE_NOISE + ent.COMMON_WORDS)}, trim(low)) or length(trim(low)) < 3 or regexp_full_match(trim(low), '[\\d.]+') or regexp_full_match(trim(low), '@[\\p{{L}}\\p{{N}}_]+\\.(com|org|net|io|co)') as blocked_person,
  case kind when 'service' then list_contains({sql_list(ent.SERVICE_BLOCKLIST)}, low) or length(name) < 4 else list_contains({sql_list(ent.PRODUCT_BLOCKLIST)}, low) or length(name) < 5 end as blocked_entity
from (select *, length(name) >= 4 and not (words = 1 and ((name = upper(name) and name <> lower(name)) or list_contains({sql_list(fr.NAME_LIST_NOISE + fr.GENERIC_WORDS)}, low))) as good
  from (select *, lower(name) as low, {_WORDS} as words from ({_NAMES}) n) a) b""")
def name_quality(spark, sf_dir):
    n = derive(spark, sf_dir, _NAMES.replace("upper(text)", "text"))
    n = n.withColumn("name", F.when(F.col("doc_id") % 6 == 1, fn.upper_letters(F.col("name"))).otherwise(F.col("name")))
    name = F.col("name")
    return n.select("doc_id", fn.quality_entity(name).alias("good"), fn.quality_entity(name, "contact").alias("contact"), fn.quality_entity(name, "company").alias("company"),
                    fn.blocked_person(name).alias("blocked_person"), fn.blocked_entity(F.col("kind"), name).alias("blocked_entity"))


@query("link_domains", "F45 P16", """
select page_id, case when contains(h, '.') and length(h) > 4 then h end as domain, regexp_matches(replace(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1), 'www.', ''), 'youtube\\.com|youtu\\.be|facebook\\.com|fb\\.watch') as is_video
from (select *, lower(split_part(split_part(regexp_replace(url, '^https?://(www\\.)?', ''), '/', 1), '?', 1)) as h from {pages}) p""")
def link_domains(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", ft.url_domain(F.col("url")).alias("domain"), ft.is_video_url(F.col("url")).alias("is_video"))


# -- names --------------------------------------------------------------------------------------

# Written names: part names with a dropped letter, swapped words or changed ending, by row.
WRITTEN = """
select case p_partkey % 5 when 0 then p_name when 1 then substring(p_name, 1, cast(p_partkey % 7 as int)) || substring(p_name, cast(p_partkey % 7 as int) + 2)
  when 2 then replace(p_name, 'e', 'a') || 's' when 3 then p_brand || ' ' || substring(p_name, 3) else p_type || ' ' || p_name end as name from {part}"""
PAGES = "select p_name as page, min(p_partkey) as rank from {part} group by p_name"
_NORM = "trim(regexp_replace(regexp_replace(lower({0}), '[^a-z\\s]', '', 'g'), '\\s+', ' ', 'g'))"
_SCORE = """case when a = '' or b = '' then 0 when a = b then 100
  when la = lb and fa = fb then 95 when la = lb and substring(fa, 1, 3) = substring(fb, 1, 3) then 85 when la = lb then 70
  else greatest(0, (1.0 - levenshtein(a, b) / greatest(length(a), length(b))::double) * 100.0) end"""


@query("fuzzy_name_match", "F1 F2 F3 J5 P7 W10", f"""
with l as (select distinct name, {_NORM.format('name')} as a from ({WRITTEN}) w), r as (select page, rank, {_NORM.format('page')} as b from ({PAGES}) p),
parts as (select l.*, r.*, case when contains(a, ' ') then split_part(a, ' ', -1) end as la, case when contains(b, ' ') then split_part(b, ' ', -1) end as lb,
  split_part(a, ' ', 1) as fa, split_part(b, ' ', 1) as fb from l cross join r),
s as (select name, page, rank, round(({_SCORE})::double, 6) as score from parts where a <> ''),
b as (select *, row_number() over (partition by name order by score desc, rank) as k from s where score >= 60)
select name, page as matched_page, score, case when score >= 90 then 'confirmed' else 'needs_review' end as status from b where k = 1""")
def fuzzy_name_match(spark, sf_dir):
    m = ol.fuzzy_match(derive(spark, sf_dir, WRITTEN), derive(spark, sf_dir, PAGES), "name", "page", "page", "rank")
    return m.filter(F.col("score") >= 60).withColumn("score", F.round("score", 6))


@query("name_scores", "F1 F2 F3", f"""
select x, y, round(({_SCORE})::double, 6) as score, levenshtein(a, b) as distance from (select x, y, a, b, case when contains(a, ' ') then split_part(a, ' ', -1) end as la, case when contains(b, ' ') then split_part(b, ' ', -1) end as lb,
  split_part(a, ' ', 1) as fa, split_part(b, ' ', 1) as fb from (select c_name || ' ' || c_mktsegment as x, n_name as y, {_NORM.format("c_name || ' ' || c_mktsegment")} as a, {_NORM.format('n_name')} as b from {{customer}} join {{nation}} on c_nationkey = n_nationkey) t) u""")
def name_scores(spark, sf_dir):
    t = derive(spark, sf_dir, "select c_name || ' ' || c_mktsegment as x, n_name as y from {customer} join {nation} on c_nationkey = n_nationkey")
    return t.select("x", "y", F.round(fn.name_match_score(F.col("x"), F.col("y")), 6).alias("score"),
                    fn.edit_distance(fn.normalize_name(F.col("x")), fn.normalize_name(F.col("y"))).alias("distance"))


# The words every page is titled with become a dictionary that is looked up in all documents.
KNOWN = """
select lower(w) as key, min(w) as display, min(length(w) % 2) as priority from (select WORDS as w from {benchmark}) b
where length(w) >= 4 group by lower(w)"""
SPARK_KNOWN = KNOWN.replace("WORDS", "explode(split(text, '[ \\n]+'))")
KNOWN = KNOWN.replace("WORDS", "unnest(regexp_split_to_array(text, '[ \\n]+'))")


@query("dictionary_containment", "J6", f"""
with k as ({KNOWN}), hit as (select doc_id, key, display, priority from {{documents}} d join k on contains(lower(d.text), key))
select doc_id, key, display from (select *, row_number() over (partition by doc_id order by priority, length(key) desc, key) as r from hit) h where r = 1""")
def dictionary_containment(spark, sf_dir):
    known = derive(spark, sf_dir, SPARK_KNOWN)
    found = ol.match_dictionary(derive(spark, sf_dir, DOCS), "doc_id", F.col("text"), known)
    return ol.best_dictionary_match(found, "doc_id", known, "key", "priority").select("doc_id", "key", "display")


@query("mentions", "J17 F52", f"""
with k as ({KNOWN}) select conv_id, turn, display as name from {{conversations}} join k on contains(text, display)""")
def mentions(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("id", F.concat_ws("/", "conv_id", "turn"))
    people = derive(spark, sf_dir, SPARK_KNOWN).select(F.col("display").alias("name"))
    m = ol.mentions(c, "id", F.col("text"), people)
    part = F.split("id", "/")
    return m.select(part[0].cast("bigint").alias("conv_id"), part[1].cast("bigint").alias("turn"), "name")


@query("article_matches", "J10 U4", r"""
with a as (select page_id as article_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as headline, 'The Example Site' as publisher, 2000 + page_id % 9 as year from pages),
n as (select strftime(date '2000-01-01' + interval (page_id % 9) year, '%Y') || ' - Headline - ' || case when page_id % 2 = 0 then 'example' else 'other' end || ' - ' || regexp_extract(html, '<h1>([^<]*)</h1>', 1) || '.md' as file from pages),
w as (select article_id, year, publisher, list_distinct(list_filter(regexp_extract_all(lower(headline), '[\p{L}\p{N}_]+'), lambda x: length(x) > 4)) as ws from a),
f as (select file, lower(file) as low, list_distinct(list_filter(regexp_extract_all(lower(file), '[\p{L}\p{N}_]+'), lambda x: length(x) > 4)) as fs from (select distinct file from n) d)
select article_id, min(file) as file from w join f on contains(file, cast(year as varchar)) and len(list_intersect(ws, fs)) >= 2 and (contains(low, 'example') or contains(low, 'site')) group by article_id""")
def article_matches(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    a = p.select(F.col("page_id").alias("article_id"), title.alias("headline"), F.lit("The Example Site").alias("publisher"), (F.lit(2000) + F.col("page_id") % 9).alias("year"))
    n = p.select(F.concat((F.lit(2000) + F.col("page_id") % 9).cast("string"), F.lit(" - Headline - "), F.when(F.col("page_id") % 2 == 0, "example").otherwise("other"),
                          F.lit(" - "), F.regexp_extract("html", "<h1>([^<]*)</h1>", 1), F.lit(".md")).alias("file")).distinct()
    return ol.match_articles(a, n)


@query("page_presence", "J13", """
select conv_id, bool_or(role in (select case when n_nationkey = 0 then 'tool' else 'user' end from {nation} where n_nationkey % 3 = 0) and conv_id % 2 = 0) as has_page from {conversations} group by conv_id""")
def page_presence(spark, sf_dir):
    c = derive(spark, sf_dir, "select conv_id, case when conv_id % 2 = 0 then role else 'x' || role end as role from {conversations}").groupBy("conv_id").agg(F.collect_set("role").alias("people"))
    pages = derive(spark, sf_dir, "select case when n_nationkey = 0 then 'tool' else 'user' end as title from {nation} where n_nationkey % 3 = 0")
    return ol.has_page(c, "people", pages, "conv_id").select("conv_id", "has_page")


@query("entry_texts", "J4", """
select e.conv_id, e.turn, length(coalesce(case when d.doc_id is not null then d.text end, e.text, '')) as chars from {conversations} e
left join {documents} d on d.doc_id = e.conv_id * 3 + e.turn and d.lang = 'en'""")
def entry_texts(spark, sf_dir):
    e = derive(spark, sf_dir, "select conv_id, turn, conv_id * 3 + turn as stem, 'en' as month, text as text_preview from {conversations}")
    ocr = derive(spark, sf_dir, "select doc_id as stem, lang as month, text from {documents}")
    return ol.with_text(e, ocr).select("conv_id", "turn", F.length("text").alias("chars"))


@query("note_attachments", "J19", """
with f as (select substring(cast(l_shipdate as varchar), 1, 7) as month, 'f' || l_partkey % 50 as stem, case l_linenumber % 4 when 0 then '.PNG' when 1 then '.jpg' when 2 then '.png' else '.gif' end as ext, 'p/' || l_orderkey || '-' || l_linenumber as path from {lineitem}),
b as (select month, stem, path, row_number() over (partition by month, stem order by case ext when '.PNG' then 1 when '.png' then 2 else 4 end, path) as k from f where ext <> '.gif'),
n as (select distinct strftime(o_orderdate, '%Y-%m') as month, 'f' || o_custkey % 60 as stem from {orders})
select n.month, n.stem, b.path as attachment from n left join b on n.month = b.month and n.stem = b.stem and k = 1""")
def note_attachments(spark, sf_dir):
    f = derive(spark, sf_dir, "select substring(cast(l_shipdate as string), 1, 7) as month, 'f' || l_partkey % 50 as stem, case l_linenumber % 4 when 0 then '.PNG' when 1 then '.jpg' when 2 then '.png' else '.gif' end as ext, 'p/' || l_orderkey || '-' || l_linenumber as path from {lineitem}")
    n = derive(spark, sf_dir, "select distinct date_format(o_orderdate, 'yyyy-MM') as month, 'f' || o_custkey % 60 as stem from {orders}")
    return ol.with_attachment(n, f, [".PNG", ".png", ".JPG", ".jpg"]).select("month", "stem", "attachment")


@query("display_names", "J21", """
select c_custkey, case c_mktsegment when 'MACHINERY' then 'Machines Ltd' else upper(substring(c_mktsegment, 1, 1)) || lower(substring(c_mktsegment, 2)) || ' ' || 'Daily' end as display_name from {customer}""")
def display_names(spark, sf_dir):
    c = derive(spark, sf_dir, "select c_custkey, lower(c_mktsegment) || '-daily' as slug from {customer}")
    return ol.display_name(c, "slug", {"machinery-daily": "Machines Ltd"}).select("c_custkey", "display_name")


# -- graph --------------------------------------------------------------------------------------

SHARED = "select 'order subject ' || cast(l_orderkey as varchar(20)) as subject, l_suppkey as member from {lineitem}"
# One third of all rows carries the same subject: a mass mail that must not form pairs.
SKEWED = "select case when l_linenumber % 3 = 0 then 'newsletter of the month' else 'order subject ' || cast(l_orderkey as varchar(20)) end as subject, l_suppkey as member from {lineitem}"


def pairs_sql(shared: str) -> str:
    return f"""
with g as (select distinct lower(trim(subject)) as subject, member from ({shared}) s), ok as (select subject from g group by subject having count(*) between 2 and 20)
select a.member as source, b.member as target, a.subject from g a join g b on a.subject = b.subject and a.member < b.member where a.subject in (select subject from ok)"""


_EDGES = f"select source, target, count(*) as weight from ({pairs_sql(SHARED)}) p group by 1, 2"
NODES = """
select s_suppkey as id, s_name as name, case when n_nationkey % 5 = 0 then '' else n_name end as org, case s_suppkey % 4 when 0 then '' when 1 then 'peer' when 2 then 'press' else 'vendor' end as relationship_type,
  s_suppkey % 40 as total_emails from {supplier} join {nation} on s_nationkey = n_nationkey"""
_SIG = f"""select e.* from ({_EDGES}) e left join ({NODES}) a on a.id = source left join ({NODES}) b on b.id = target
where weight >= 2 or (a.total_emails >= 20 and b.total_emails >= 20)"""
_BOTH = f"select source as node, target as neighbour, weight from ({_SIG}) s union all select target, source, weight from ({_SIG}) s"
_BRIDGE = f"""
select node, cast(count(distinct nullif(org, '')) * 2 + count(distinct nullif(relationship_type, '')) as bigint) as bridge_score
from (select *, row_number() over (partition by node order by weight desc, neighbour) as rank from ({_BOTH}) b) r left join ({NODES}) n on n.id = neighbour where rank <= 20 group by node"""


def _pairs(spark, sf_dir, shared=SHARED):
    return og.cooccurrence_pairs(og.subject_groups(derive(spark, sf_dir, shared), "subject", "member"))


def _sig(spark, sf_dir):
    return og.significant(og.edge_weights(_pairs(spark, sf_dir)), derive(spark, sf_dir, NODES))


@query("cooccurrence_edges", "A7 J7 A4", _EDGES)
def cooccurrence_edges(spark, sf_dir):
    return og.edge_weights(_pairs(spark, sf_dir))


@query("cooccurrence_skewed", "A7 J7 A4", f"select source, target, count(*) as weight from ({pairs_sql(SKEWED)}) p group by 1, 2")
def cooccurrence_skewed(spark, sf_dir):
    return og.edge_weights(_pairs(spark, sf_dir, SKEWED))


@query("edge_samples", "A4", f"""
select source, target, string_agg(substring(subject, 1, 80), '|' order by subject) as shared_subjects from (select *, row_number() over (partition by source, target order by subject) as k from ({pairs_sql(SHARED)}) p) r where k <= 5 group by 1, 2""")
def edge_samples(spark, sf_dir):
    return og.edge_samples(_pairs(spark, sf_dir))


@query("significant_edges", "P18 J8", f"""
select source, target, weight, a.name as source_name, b.name as target_name from ({_SIG}) s left join ({NODES}) a on a.id = source left join ({NODES}) b on b.id = target""")
def significant_edges(spark, sf_dir):
    return og.attach_nodes(_sig(spark, sf_dir), derive(spark, sf_dir, NODES), ["name"])


@query("degree_bridge", "A5 A6 W9", f"""
select d.node, d.connections, b.bridge_score from (select node, count(*) as connections from ({_BOTH}) b group by node) d join ({_BRIDGE}) b using (node)""")
def degree_bridge(spark, sf_dir):
    e = materialise(_sig(spark, sf_dir), "edges")
    return og.degree(e).join(og.bridge_score(e, derive(spark, sf_dir, NODES)), "node")


@query("top_connectors", "L2 J8 W9", f"""
with top as (select node, count(*) as connections from ({_BOTH}) b group by node order by 2 desc, 1 limit 500),
r as (select *, row_number() over (partition by node order by weight desc, neighbour) as rank from ({_BOTH}) b)
select top.node, connections, bridge_score, (select string_agg(m.name || '(' || weight || ')', ', ' order by rank) from r join ({NODES}) m on m.id = r.neighbour where r.node = top.node and rank <= 5) as top_connections, n.name, cast(n.total_emails as bigint) as total_emails
from top left join ({_BRIDGE}) b using (node) left join ({NODES}) n on n.id = top.node""")
def top_connectors(spark, sf_dir):
    c = og.connectors(_sig(spark, sf_dir), derive(spark, sf_dir, NODES))
    return c.select("node", "connections", "bridge_score", "top_connections", "name", "total_emails")


@query("graph_stats", "K3", f"select (select count(*) from ({NODES}) n) as total_nodes, (select count(*) from ({_SIG}) e) as total_edges")
def graph_stats(spark, sf_dir):
    return og.graph_stats(derive(spark, sf_dir, NODES), _sig(spark, sf_dir))


