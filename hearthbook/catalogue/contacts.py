"""Queries on contacts: customers stand for contacts, their orders for mail."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthbook.catalogue.base import derive, query, sql_list
from hearthbook.functions import mail as fm, render, scores as sc
from hearthbook.functions.dates import gap_days
from hearthbook.functions.names import page_name
from hearthbook.operators import contacts as oc, ordering as oo
from hearthbook.rulesets import mail as rm

AS_OF = "2001-08-02"

MAIL = """
select o_orderkey as msg_id, 'contact' || cast(o_custkey as varchar(20)) || '@mail.example' as contact, o_orderdate as ts,
  case o_orderstatus when 'F' then 'from' when 'O' then 'to' else 'cc' end as direction, o_orderpriority as account,
  o_totalprice as amount
from {orders}"""

COUNTS = f"""
select contact as email, count(*) as total_emails, count(*) filter (where direction = 'from') as emails_from,
  count(*) filter (where direction = 'to') as emails_to, count(*) filter (where direction = 'cc') as emails_cc,
  min(ts) as first_contact, max(ts) as last_contact from ({MAIL}) m group by contact"""

STRENGTH = f"""
select *, date_diff('day', last_contact, timestamp '{AS_OF}') as gap_days, cast(round_even(least(100, greatest(0,
   least(15, log2(total_emails) * 15 / log2(500))
   + least(1, greatest(0, 1 - date_diff('day', last_contact, timestamp '{AS_OF}') / 730.0)) * 40
   + case when emails_from > 0 and emails_to > 0
          then least(emails_from, emails_to) / greatest(emails_from, emails_to) * 45
          when emails_from > 0 or emails_to > 0 then 10 else 0 end)), 0) as bigint) as strength
from ({COUNTS}) c"""


def counts(spark, sf_dir):
    return oc.contact_counts(derive(spark, sf_dir, MAIL)).withColumnRenamed("contact", "email")


def strengths(spark, sf_dir):
    c = counts(spark, sf_dir)
    s = sc.relationship_strength(F.col("total_emails"), F.col("last_contact"), F.col("emails_from"), F.col("emails_to"), AS_OF)
    return c.withColumn("gap_days", gap_days(F.col("last_contact"), AS_OF)).withColumn("strength", s)


TIER_SQL = "case when total_emails >= 10 then 'A' when total_emails >= 5 then 'B' else 'C' end"


@query("relationship_strength", "F25 F26 P6 L1", f"""
select email, total_emails, gap_days, strength, {TIER_SQL} as tier from ({STRENGTH}) s""")
def relationship_strength(spark, sf_dir):
    s = strengths(spark, sf_dir)
    return oo.rank_by(s.select("email", "total_emails", "gap_days", "strength",
                               fm.volume_tier(F.col("total_emails")).alias("tier")), "strength", "email")


@query("contact_rollup", "A1 P4", f"""
select email, total_emails, emails_from, emails_to, emails_cc, epoch_us(first_contact) as first_contact,
  epoch_us(last_contact) as last_contact from ({COUNTS}) c""")
def contact_rollup(spark, sf_dir):
    return counts(spark, sf_dir)


@query("strength_distribution", "A24", f"""
select t.threshold, count(*) filter (where strength >= t.threshold) as contacts
from ({STRENGTH}) s cross join (select cast(unnest([75, 50, 25, 10, 0]) as bigint) as threshold) t group by t.threshold""")
def strength_distribution(spark, sf_dir):
    return oc.strength_distribution(strengths(spark, sf_dir), "strength")


@query("drip_subset", "P11", f"select email, strength, gap_days from ({STRENGTH}) s where strength >= 25 and gap_days < 730")
def drip_subset(spark, sf_dir):
    s = strengths(spark, sf_dir)
    return s.filter(sc.drip_member(F.col("strength"), F.col("gap_days"))).select("email", "strength", "gap_days")


@query("top_contacts", "L1 L2", f"select email, strength from ({STRENGTH}) s order by strength desc, email limit 20")
def top_contacts(spark, sf_dir):
    return oo.top_k(strengths(spark, sf_dir).select("email", "strength"), [F.desc("strength"), F.asc("email")], 20)


# Five accounts (order priorities) hold rows of the same contact; some fields are blank.
ACCOUNT_ROWS = f"""
select contact as email, account as source_account, max(msg_id) as pos, count(*) as n, min(ts) as first_contact, max(ts) as last_contact,
  case when sum(msg_id) % 3 = 0 then 'Name ' || contact else '' end as name,
  case when sum(msg_id) % 4 = 0 then 'phone ' || cast(max(msg_id) as varchar(20)) else '' end as phone,
  case when sum(msg_id) % 2 = 0 then 'org ' || account else '' end as organization,
  case when sum(msg_id) % 5 = 0 then true else false end as has_enrichment
from ({MAIL}) m group by contact, account"""

_FILLED = ["name", "phone", "organization"]


@query("merge_accounts", "A2 U2", f"""
with r as (select *, row_number() over (partition by email order by (case when has_enrichment then 0 else 1 end), pos) as k from ({ACCOUNT_ROWS}) a)
select email, {", ".join(f"first({c} order by k) filter (where {c} <> '') as {c}" for c in _FILLED)},
  cast(sum(n) as bigint) as total_emails, epoch_us(min(first_contact)) as first_contact, epoch_us(max(last_contact)) as last_contact,
  string_agg(distinct source_account, ', ' order by source_account) as source_accounts,
  bool_or(has_enrichment) as has_enrichment, count(*) as merged_rows
from r group by email""")
def merge_accounts(spark, sf_dir):
    rows = derive(spark, sf_dir, ACCOUNT_ROWS).withColumn("total_emails", F.col("n").cast("string"))
    frames = [rows.filter(F.col("pos") % 2 == 0), rows.filter(F.col("pos") % 2 == 1).withColumn("extra", F.lit(1))]
    return oc.merge_accounts(oc.union_wide(frames), filled=_FILLED)


@query("multi_account_contacts", "L5 A2", f"""
with r as (select email, source_account, n from ({ACCOUNT_ROWS}) a)
select email, string_agg(distinct source_account, ', ' order by source_account) as source_accounts, cast(sum(n) as bigint) as total_emails
from r group by email having count(distinct source_account) > 1 order by total_emails desc, email limit 20""")
def multi_account_contacts(spark, sf_dir):
    rows = derive(spark, sf_dir, ACCOUNT_ROWS).withColumn("total_emails", F.col("n").cast("string"))
    merged = oc.merge_accounts(rows, filled=_FILLED).select("email", "source_accounts", "total_emails")
    return oc.multi_account(merged, "total_emails")


@query("merge_graph_contacts", "A3", f"""
with r as (select email, source_account, pos, n, name, organization, first_contact, last_contact,
  case when has_enrichment then 'peer ' || cast(pos % 4 as varchar(3)) end as kind from ({ACCOUNT_ROWS}) a)
select email, cast(sum(n) as bigint) as total_emails, string_agg(distinct source_account, '|' order by source_account) as source_accounts,
  first(kind order by pos) filter (where kind is not null) as relationship_type,
  first(organization order by pos) filter (where organization <> '') as org, first(name order by pos) as name,
  epoch_us(min(first_contact)) as first_contact, epoch_us(max(last_contact)) as last_contact
from r group by email""")
def merge_graph_contacts(spark, sf_dir):
    rows = derive(spark, sf_dir, ACCOUNT_ROWS).withColumnRenamed("n", "total_emails").withColumnRenamed("organization", "org")
    kind = F.when(F.col("has_enrichment"), F.concat(F.lit("peer "), (F.col("pos") % 4).cast("string")))
    return oc.merge_graph_contacts(rows.withColumn("relationship_type", kind))


# -- address sources ----------------------------------------------------------------------------

ADDR_CUSTOMER = "select ' Contact' || cast(c_custkey as varchar(20)) || '@Mail.example ' as email from {customer}"
ADDR_ORDERS = "select 'contact' || cast(o_custkey + 500 as varchar(20)) || '@mail.example' as email from {orders}"
ADDR_EVENTS = "select case when user_id % 3 = 0 then 'nobody' else 'contact' || cast(user_id * 40 as varchar(20)) || '@mail.example' end as email from {events}"
OWN = ["contact0@mail.example", "contact40@mail.example", "contact777@mail.example"]

_UNION = f"""
select lower(trim(email)) as email, min(src) as source from (
  select email, 1 as src from ({ADDR_CUSTOMER}) a union all select email, 2 from ({ADDR_ORDERS}) b union all select email, 3 from ({ADDR_EVENTS}) c) u
where contains(email, '@') and not list_contains({sql_list(OWN)}, lower(trim(email))) group by 1"""


def _addresses(spark, sf_dir):
    return oc.union_addresses([derive(spark, sf_dir, s) for s in (ADDR_CUSTOMER, ADDR_ORDERS, ADDR_EVENTS)], OWN)


@query("address_union", "U1 U3", f"select email, cast(source as bigint) as source from ({_UNION}) u")
def address_union(spark, sf_dir):
    return _addresses(spark, sf_dir)


@query("address_contributions", "U1", f"select cast(source as bigint) as source, count(*) as new_addresses from ({_UNION}) u group by 1")
def address_contributions(spark, sf_dir):
    return oc.source_contributions(_addresses(spark, sf_dir))


# -- mail predicates ----------------------------------------------------------------------------

SENDERS = """
select doc_id, text as body,
  case when doc_id % 11 = 0 then 'NoReply' when doc_id % 13 = 0 then 'marketing' else 'user' || cast(doc_id % 97 as varchar(5)) end || '@' ||
  case doc_id % 7 when 0 then 'shop.shopify.com' when 1 then 'stripe.com' when 2 then 'post.xero.com' else 'mail' || cast(doc_id % 5 as varchar(5)) || '.example' end as sender,
  case when doc_id % 17 = 0 then '<mailto:x>' end as list_unsub, case when doc_id % 19 = 0 then 'Bulk' when doc_id % 23 = 0 then 'first' end as precedence,
  'user' || cast((doc_id * 3) % 97 as varchar(5)) || '@mail1.example' as contact
from {documents}"""
SELF = ["user5@mail3.example", "user6@mail4.example", "user7@mail0.example"]
_AUTO = f"""(exists (select 1 from (select unnest({sql_list(rm.AUTOMATED_SENDER_PARTS)}) as p) x where contains(lower(sender), p))
  or exists (select 1 from (select unnest({sql_list(rm.BULK_DOMAINS)}) as p) x where ends_with(split_part(lower(sender), '@', 2), p))
  or coalesce(list_unsub, '') <> '' or coalesce(lower(precedence) in ('bulk', 'list', 'junk'), false))"""
_SERVICE = f"""(list_contains({sql_list(rm.SERVICE_ADDRESSES)}, sender)
  or exists (select 1 from (select unnest({sql_list(rm.SERVICE_DOMAINS)}) as p) x where ends_with(split_part(sender, '@', 2), p)))"""
_DIR = f"(case when sender = contact then 'from' when list_contains({sql_list(SELF)}, sender) then 'to' else 'cc' end)"


@query("mail_predicates", "P1 P3 P4 P5", f"""
select doc_id, sender, {_AUTO} as automated, {_SERVICE} as service, {_DIR} as direction,
  case when {_DIR} in ('from', 'to') and length(body) > 30 then cast(length(body) as bigint) end as kept_chars from ({SENDERS}) s""")
def mail_predicates(spark, sf_dir):
    s = derive(spark, sf_dir, SENDERS)
    side = fm.direction(F.col("sender"), F.col("contact"), SELF)
    return s.select(
        "doc_id", "sender", fm.is_automated(F.col("sender"), F.col("list_unsub"), F.col("precedence")).alias("automated"),
        fm.is_service(F.col("sender")).alias("service"), side.alias("direction"),
        F.length(fm.usable_body(F.col("body"), side)).alias("kept_chars"))


KNOWN = "select 'user' || cast(c_custkey % 60 as varchar(5)) || '@mail' || cast(c_custkey % 5 as varchar(5)) || '.example' as email from {customer}"


@query("known_not_self", "P2 J12", f"""
select sender, count(*) as mails from ({SENDERS}) s
where sender in (select email from ({KNOWN}) k) and not list_contains({sql_list(SELF)}, sender) group by sender""")
def known_not_self(spark, sf_dir):
    kept = oc.known_not_self(derive(spark, sf_dir, SENDERS), "sender", derive(spark, sf_dir, KNOWN), SELF)
    return kept.groupBy("sender").agg(F.count(F.lit(1)).alias("mails"))


# Messages with recipient lists: an order is a message, its suppliers are the recipients.
RECIPIENTS = """
select l_orderkey as msg_id, 's' || cast(l_suppkey as varchar(20)) || '@mail.example' as addr from {lineitem} group by l_orderkey, l_suppkey"""
MESSAGES = "select o_orderkey as msg_id, 's' || cast(o_custkey % 100 as varchar(20)) || '@mail.example' as sender, o_orderdate as ts from {orders}"
TEAM = ["s1@mail.example", "s2@mail.example", "s3@mail.example"]
BOOK = "select 's' || cast(s_suppkey as varchar(20)) || '@mail.example' as email from {supplier} where s_suppkey % 4 <> 0"


@query("contact_fan_out", "U6 J12 P4", f"""
with m as ({MESSAGES}), everyone as (select msg_id, sender as addr from m union select r.msg_id, r.addr from ({RECIPIENTS}) r where r.msg_id in (select msg_id from m)),
kept as (select e.msg_id, e.addr as contact, m.sender from everyone e join m using (msg_id)
  where e.addr in (select email from ({BOOK}) b) and not list_contains({sql_list(TEAM)}, e.addr))
select contact, case when sender = contact then 'from' when list_contains({sql_list(TEAM)}, sender) then 'to' else 'cc' end as direction, count(*) as mails
from kept group by 1, 2""")
def contact_fan_out(spark, sf_dir):
    rec = derive(spark, sf_dir, RECIPIENTS).groupBy("msg_id").agg(
        F.collect_list(F.struct(F.lit("").alias("name"), "addr")).alias("recipients"))
    msgs = derive(spark, sf_dir, MESSAGES).join(rec, "msg_id", "left")
    empty = F.array().cast("array<struct<name:string,addr:string>>")
    none = F.lit(None).cast("string")
    full = msgs.select("msg_id", "sender", F.lit("").alias("sender_name"), F.coalesce("recipients", empty).alias("recipients"),
                       "ts", F.lit("").alias("subject"), F.lit("").alias("body"), none.alias("list_unsub"), none.alias("precedence"))
    out = oc.contact_messages(full, derive(spark, sf_dir, BOOK), TEAM)
    return out.groupBy("contact", "direction").agg(F.count(F.lit(1)).alias("mails"))


SUBJECTS = """
select l_suppkey as contact, p_name || ' ' || p_type as subject, l_shipdate as ts, l_orderkey * 10 + l_linenumber as msg_id
from {lineitem} join {part} on l_partkey = p_partkey"""


@query("first_subjects", "A1 W7", f"""
with f as (select contact, subject, min((ts, msg_id)) as seen from ({SUBJECTS}) s group by contact, subject)
select contact, subject, rank from (select contact, subject, row_number() over (partition by contact order by seen) as rank from f) r where rank <= 30""")
def first_subjects(spark, sf_dir):
    return oc.first_subjects(derive(spark, sf_dir, SUBJECTS), "contact", "subject", ["ts", "msg_id"])


BODIES = "select source, doc_id, text from {documents}"
_SAMPLE = """
with n as (select source, doc_id, length(text) as len, row_number() over (partition by source order by doc_id) as pos,
  count(*) over (partition by source) as total, row_number() over (partition by source order by length(text) desc, doc_id) as by_len from {documents})
select source, doc_id, pos from n where total <= 20 or pos <= 5 or pos > total - 5 or by_len = 1
  or (pos > 5 and pos <= total - 5 and (pos - 6) % greatest(1, (total - 10) // 10) = 0 and (pos - 6) / greatest(1, (total - 10) // 10) < 10)"""


@query("stratified_sample", "W1", _SAMPLE)
def stratified_sample(spark, sf_dir):
    return oo.stratified_sample(derive(spark, sf_dir, BODIES), ["source"], "doc_id", "text").select("source", "doc_id", "pos")


@query("char_budget", "W2", """
with r as (select source, doc_id, length(text) as len, coalesce(sum(length(text)) over (partition by source order by doc_id
  rows between unbounded preceding and 1 preceding), 0) as used from {documents})
select source, doc_id, cast(least(len, 50000 - used) as bigint) as chars from r where used <= 50000""")
def char_budget(spark, sf_dir):
    kept = oo.char_budget(derive(spark, sf_dir, BODIES), ["source"], "doc_id", "text", 50000)
    return kept.select("source", "doc_id", F.length("text").alias("chars"))


# -- lookups ------------------------------------------------------------------------------------

ADDRESS_BOOK = """
select 'contact' || cast(c_custkey as varchar(20)) || '@mail.example' as email, case when c_custkey % 3 = 0 then c_name end as gc_name,
  case when c_custkey % 5 = 0 then 'gc-phone' end as gc_phone, c_mktsegment as gc_org, case when c_custkey % 2 = 0 then 'title' end as gc_title,
  case when c_custkey % 4 = 0 then 'city' || cast(c_nationkey as varchar(5)) end as gc_city, 'region' || cast(c_nationkey as varchar(5)) as gc_region
from {customer} where c_custkey % 7 <> 0"""
CRM = """
select 'contact' || cast(s_suppkey * 3 as varchar(20)) || '@mail.example' as email, s_name as crm_name, 'crm-phone' as crm_phone,
  case when s_suppkey % 2 = 0 then 'crm-city' end as crm_city, 'state' || cast(s_nationkey as varchar(5)) as crm_state from {supplier}"""


@query("lookup_precedence", "J1 J2 F46", f"""
select b.email, g.email is not null as gc_match, c.email is not null as crm_match, coalesce(gc_name, crm_name, 'display ' || b.email, '') as best_name,
  coalesce(gc_phone, crm_phone, 'sig') as best_phone, gc_org as best_org, coalesce(gc_title, null) as best_title, coalesce(gc_city, crm_city) as best_city,
  case when gc_city is not null then gc_region when c.email is not null then crm_state else gc_region end as best_region
from (select distinct contact as email from ({MAIL}) m) b left join ({ADDRESS_BOOK}) g using (email) left join ({CRM}) c using (email)""")
def lookup_precedence(spark, sf_dir):
    b = derive(spark, sf_dir, MAIL).select(F.col("contact").alias("email")).distinct()
    b = b.withColumn("display_names", F.array(F.concat(F.lit("display "), "email"))).withColumn(
        "phones_from_sig", F.array(F.lit("sig"))).withColumn("titles_from_sig", F.array().cast("array<string>"))
    out = oc.best_values(oc.with_crm(oc.with_address_book(b, derive(spark, sf_dir, ADDRESS_BOOK)), derive(spark, sf_dir, CRM)))
    return out.select("email", "gc_match", "crm_match", "best_name", "best_phone", "best_org", "best_title", "best_city", "best_region")


RESULTS = "select 'contact' || cast(c_custkey as varchar(20)) || '@mail.example' as email, c_mktsegment as relationship_type from {customer} where c_custkey % 2 = 0"
_ENRICHED = f"""
select c.email, total_emails, case when total_emails >= 10 then 'A' when total_emails >= 3 then 'B' else 'C' end as enrichment_tier,
  case when r.email is not null then 'enriched' when total_emails < 3 then 'metadata_only' else 'unmatched' end as enrichment_state, relationship_type
from ({COUNTS}) c left join ({RESULTS}) r using (email)"""


def _enriched(spark, sf_dir):
    return oc.with_enrichment(counts(spark, sf_dir).select("email", "total_emails"), derive(spark, sf_dir, RESULTS))


@query("enrichment_join", "J3 P6", _ENRICHED)
def enrichment_join(spark, sf_dir):
    return _enriched(spark, sf_dir).select("email", "total_emails", "enrichment_tier", "enrichment_state", "relationship_type")


@query("enrichment_stats", "A32", f"select enrichment_state, count(*) as contacts from ({_ENRICHED}) e group by 1")
def enrichment_stats(spark, sf_dir):
    return oc.enrichment_stats(_enriched(spark, sf_dir))


@query("coverage", "A25", f"""
select count(*) as total, count(*) filter (where gc_name is not null) as with_name, count(*) filter (where gc_phone is not null) as with_phone,
  count(*) filter (where gc_city is not null) as with_city from ({ADDRESS_BOOK}) a""")
def coverage(spark, sf_dir):
    book = derive(spark, sf_dir, ADDRESS_BOOK)
    return oc.coverage(book, {"with_name": F.col("gc_name").isNotNull(), "with_phone": F.col("gc_phone").isNotNull(),
                              "with_city": F.col("gc_city").isNotNull()})


@query("resume_anti_join", "J11 ST6", """
select o_orderkey, o_custkey from {orders} where not exists (select 1 from {lineitem} where l_orderkey = o_orderkey and l_returnflag = 'R')""")
def resume_anti_join(spark, sf_dir):
    todo = derive(spark, sf_dir, "select o_orderkey, o_custkey from {orders}")
    done = derive(spark, sf_dir, "select l_orderkey as o_orderkey from {lineitem} where l_returnflag = 'R'")
    return oc.not_done(todo, done, ["o_orderkey"])


@query("page_actions", "P9 P10", f"""
select email, case when total_emails % 7 = 0 then 'update'
  when total_emails % 2 = 0 and total_emails >= 10 and (strength >= 50 or total_emails >= 30 or emails_cc = 3) then 'create' else 'none' end as action,
  case when emails_from > 2 then upper(substring(email, 1, 1)) || substring(replace(email, '@mail.example', '-X'), 2) end as page
from ({STRENGTH}) s""")
def page_actions(spark, sf_dir):
    s = strengths(spark, sf_dir)
    status = F.when(F.col("total_emails") % 7 == 0, "confirmed").otherwise("no_match")
    kind = F.when(F.col("emails_cc") == 3, "press").otherwise("peer")
    raw = F.when(F.col("emails_from") > 2, F.replace(F.concat(F.lit(" '"), "email", F.lit("'")), F.lit("@mail.example"), F.lit("/x"))).otherwise(F.col("email"))
    act = sc.page_action(status, F.col("total_emails") % 2 == 0, F.col("total_emails"), F.col("strength"), kind)
    return s.select("email", act.alias("action"), page_name(raw).alias("page"))


@query("person_pages", "T8", f"""
select email, '---' || chr(10) || 'type: person' || chr(10) || 'status: working' || chr(10) || 'last_updated: 2024-01-01' || chr(10) || 'aliases:' || chr(10) || '  - ' || email || chr(10) || 'email_contact: ' || email || chr(10) ||
  'related_projects:' || case when emails_cc % 2 = 0 then chr(10) || '  - Dome' else ' []' end || chr(10) || '---' || chr(10) || chr(10) || '# N' || email || chr(10) || chr(10) || '## Who they are' || chr(10) ||
  case when emails_to % 3 = 0 and emails_from % 2 = 0 then 'Curator. Relationship type: press.' when emails_to % 3 = 0 then 'Curator.' when emails_from % 2 = 0 then 'Relationship type: press.' else 'Contact from email archive.' end || chr(10) || chr(10) ||
  '## Relationship' || chr(10) || case when total_emails % 5 > 0 then 'met ' || total_emails when emails_from % 2 = 0 then 'Press relationship via email archive.' else 'Unknown relationship via email archive.' end || chr(10) || chr(10) ||
  '## Key interactions' || chr(10) || '| Date | Context | Notes |' || chr(10) || '|------|---------|-------|' || chr(10) || '| ' || strftime(first_contact, '%Y-%m-%d') || ' | hello | Inbound |' || chr(10) || '| ' || strftime(last_contact, '%Y-%m-%d') || ' | (no subject) | Outbound |' || chr(10) || chr(10) ||
  '## Projects in common' || chr(10) || case when emails_cc % 2 = 0 then '- [[Dome]]' else '-' end || chr(10) || chr(10) || '## Source notes' || chr(10) || '- (Source: email archive, ' || strftime(first_contact, '%Y-%m-%d') || ' to ' || strftime(last_contact, '%Y-%m-%d') || ')' ||
  chr(10) || chr(10) || '## Open questions' || chr(10) || '-' || chr(10) as page from ({COUNTS}) c""")
def person_pages(spark, sf_dir):
    c = counts(spark, sf_dir)
    turn = lambda day, subject, side: F.struct(F.col(day).alias("date"), F.lit(subject).cast("string").alias("subject"), F.lit(side).alias("direction"))
    c = c.select(
        "email", "first_contact", "last_contact", F.concat(F.lit("N"), "email").alias("name"), F.when(F.col("emails_from") % 2 == 0, "press").otherwise("").alias("relationship_type"),
        F.when(F.col("emails_to") % 3 == 0, "Curator").alias("role_title"), F.lit(None).cast("string").alias("communication_style"), F.lit("").alias("notable_context"),
        F.when(F.col("total_emails") % 5 > 0, F.concat(F.lit("met "), "total_emails")).alias("relationship_summary"),
        F.when(F.col("emails_cc") % 2 == 0, F.array(F.lit("Dome"))).alias("projects_in_common"),
        F.array(turn("first_contact", "hello", "from"), turn("last_contact", None, "to")).alias("threads"))
    return c.select("email", render.person_page("2024-01-01").alias("page"))


@query("contact_briefs", "F43", f"""
select email, 'Contact: ' || email || chr(10) || 'Email: ' || email || chr(10) || 'Total emails: ' || total_emails || chr(10) ||
  'Date range: ' || strftime(first_contact, '%Y-%m-%d') || ' to ' || strftime(last_contact, '%Y-%m-%d') as brief from ({COUNTS}) c""")
def contact_briefs(spark, sf_dir):
    c = counts(spark, sf_dir).withColumn("display_names", F.array("email")).withColumn(
        "best_org", F.lit(None).cast("string")).withColumn("unique_subjects", F.array().cast("array<string>"))
    c = c.withColumn("first_contact", F.date_format("first_contact", "yyyy-MM-dd")).withColumn(
        "last_contact", F.date_format("last_contact", "yyyy-MM-dd"))
    return c.select("email", render.contact_brief("B").alias("brief"))


@query("model_answers", "F42", """
select o_orderkey, case o_orderkey % 4 when 0 then 'buyer' end as role_title, case o_orderkey % 4 when 0 then o_orderpriority when 1 then 'peer' end as relationship_type,
  case when o_orderkey % 4 = 2 then 'JSON parse error' end as error, case when o_orderkey % 4 = 2 then 'sorry, no answer for ' || o_orderkey end as raw from {orders}""")
def model_answers(spark, sf_dir):
    o = derive(spark, sf_dir, "select o_orderkey, o_orderpriority from {orders}")
    key = F.col("o_orderkey") % 4
    answer = (
        F.when(key == 0, F.concat(F.lit('{"role_title": "buyer", "relationship_type": "'), "o_orderpriority", F.lit('"}')))
        .when(key == 1, F.lit('```json\n{"relationship_type": "peer"}\n```'))
        .when(key == 2, F.concat(F.lit("sorry, no answer for "), "o_orderkey")).otherwise(F.lit('{"role_title": null}')))
    parsed = o.withColumn("_p", render.parse_response(answer))
    return parsed.select("o_orderkey", "_p.role_title", "_p.relationship_type", "_p.error", "_p.raw")
