"""Whole pipelines over one message table: orders are messages, their suppliers the people on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthbook.catalogue.base import derive, query, table
from hearthbook.catalogue.texts import first_hit_sql
from hearthbook.operators import contacts as oc, graph as og
from hearthbook.plans import pipelines
from hearthbook.rulesets import timeline as rt

OWN = "me@own.example"

# One row per message; every third is from its first supplier, the others are the owner's.
MESSAGES = """
select o_orderkey as msg_id, o_orderdate as ts, case o_orderkey % 4 when 0 then 'Re: Fwd: ' when 1 then 'FW: ' else '' end || 'Talk about the yearly works number ' ||
  cast(cast(floor(o_orderkey / 4) as bigint) as varchar(20)) as subject, o_orderkey % 3 = 0 as theirs, 'Dear all, this is to say that we have ' ||
  case o_orderkey % 5 when 0 then 'shipped' when 1 then 'paid the invoice for' when 2 then 'seen' when 3 then 'booked' else 'heard about' end || ' the parts of order ' || cast(o_orderkey as varchar(20)) as body,
  '555-010-' || substring(cast(10000 + o_orderkey % 9973 as varchar(9)), 2, 4) as phone, case o_orderkey % 2 when 0 then 'Supplier ' else 'S. Supplier ' end as called
from {orders}"""
PEOPLE = "select distinct l_orderkey as msg_id, l_suppkey as who from {lineitem}"
# What the fan-out gives, written for the oracle: known suppliers of each message with their direction.
_CM = f"""
(with m as ({MESSAGES}), p as ({PEOPLE}), f as (select msg_id, min(who) as sender from p group by msg_id),
 c as (select m.*, p.who, f.sender, 's' || p.who || '@mail.example' as contact, case when theirs and p.who = f.sender then 'from' when theirs then 'cc' else 'to' end as direction
       from m join p using (msg_id) join f using (msg_id) where p.who % 5 <> 0)
 select msg_id, ts, contact, subject, direction, called || who as shown, case when direction = 'cc' then '' when theirs then body || chr(10) || '--' || chr(10) || 'Manager of Sales' || chr(10) || phone else body end as body,
   case when direction = 'from' then phone end as phone, case when direction = 'from' then 'Manager of Sales' end as title from c)"""


def raw_messages(spark, sf_dir):
    """Messages as a mailbox gives them, and the known addresses."""
    mail = derive(spark, sf_dir, MESSAGES, wide=("orders",))
    addr = F.concat(F.lit("s"), F.col("who").cast("string"), F.lit("@mail.example"))
    people = derive(spark, sf_dir, PEOPLE).groupBy("msg_id").agg(F.array_sort(F.collect_list("who")).alias("who"))
    joined = mail.join(people, "msg_id")
    address = lambda w: F.concat(F.lit("s"), w.cast("string"), F.lit("@mail.example"))
    first = F.get("who", F.lit(0))
    signed = F.concat_ws("\n", "body", F.lit("--"), F.lit("Manager of Sales"), "phone")
    shaped = joined.select(
        "msg_id", "ts", "subject", F.when(F.col("theirs"), address(first)).otherwise(OWN).alias("sender"),
        F.when(F.col("theirs"), F.concat("called", first.cast("string"))).otherwise("Me").alias("sender_name"),
        F.transform("who", lambda w: F.struct(F.concat("called", w.cast("string")).alias("name"), address(w).alias("addr"))).alias("recipients"),
        F.when(F.col("theirs"), signed).otherwise(F.col("body")).alias("body"), F.lit("").alias("list_unsub"), F.lit("").alias("precedence"))
    known = table(spark, sf_dir, "supplier").filter("s_suppkey % 5 <> 0").select(F.col("s_suppkey").alias("who")).select(addr.alias("email"))
    return shaped, known


def messages(spark, sf_dir):
    """The stored message table of the queries below."""
    return pipelines.message_table(*raw_messages(spark, sf_dir), [OWN])


@query("contact_bundle", "A1 W1 W2 U6 X2", f"""
with cm as {_CM}, counts as (select contact, count(*) as total_emails, count(*) filter (direction = 'from') as emails_from, count(*) filter (direction = 'to') as emails_to,
  count(*) filter (direction = 'cc') as emails_cc, epoch_us(min(ts)) as first_contact, epoch_us(max(ts)) as last_contact from cm group by contact),
names as (select contact, string_agg(shown, '|' order by length(shown) desc, shown) as display_names from (select distinct contact, shown from cm) d group by contact),
phones as (select contact, string_agg(phone, '|' order by phone) as phones from (select distinct contact, phone from cm where phone is not null) d group by contact),
titles as (select contact, string_agg(distinct title, '|') as titles from cm group by contact),
firsts as (select contact, subject, row_number() over (partition by contact order by seen) as k from (select contact, subject, min((ts, msg_id)) as seen from cm group by contact, subject) s),
subjects as (select contact, string_agg(subject, '|' order by k) as subjects from firsts where k <= 30 group by contact),
b as (select *, row_number() over (partition by contact order by ts, msg_id) as pos, count(*) over (partition by contact) as total,
  row_number() over (partition by contact order by length(body) desc, ts, msg_id) as by_len from cm where length(body) > 30),
threads as (select contact, count(*) as emails_sampled, sum(length(body)) as chars, string_agg(direction || ' ' || subject, '|' order by pos) as threads from b
  where total <= 20 or pos <= 5 or pos > total - 5 or by_len = 1
    or (pos > 5 and pos <= total - 5 and (pos - 6) % greatest(1, (total - 10) // 10) = 0 and (pos - 6) / greatest(1, (total - 10) // 10) < 10) group by contact)
select contact as email, total_emails, emails_from, emails_to, emails_cc, first_contact, last_contact, display_names, phones, titles, subjects, emails_sampled, chars::bigint as chars, threads
from counts left join names using (contact) left join phones using (contact) left join titles using (contact) left join subjects using (contact) left join threads using (contact)""")
def contact_bundle(spark, sf_dir):
    b = oc.contact_rollup(messages(spark, sf_dir))
    lines = F.transform("threads", lambda t: F.concat_ws(" ", t["direction"], t["subject"]))
    chars = F.aggregate("threads", F.lit(0).cast("long"), lambda n, t: n + F.length(t["body_snippet"]))
    return b.select("email", "total_emails", "emails_from", "emails_to", "emails_cc", "first_contact", "last_contact", "display_names",
                    F.col("phones_from_sig").alias("phones"), F.col("titles_from_sig").alias("titles"), F.col("unique_subjects").alias("subjects"),
                    "emails_sampled", chars.alias("chars"), lines.alias("threads"))


_EDGES = f"""
with cm as {_CM}, t as (select contact, count(*) as total from cm group by contact), g as (select distinct lower(trim(subject)) as subject, contact from cm where length(trim(subject)) > 10),
ok as (select subject from g group by subject having count(*) between 2 and 20),
p as (select a.contact as source, b.contact as target, subject from g a join g b using (subject) where a.contact < b.contact and subject in (select subject from ok)),
e as (select source, target, count(*) as weight from p group by 1, 2),
s as (select source, target, string_agg(substring(subject, 1, 80), '|' order by subject) as shared_subjects from (select *, row_number() over (partition by source, target order by subject) as k from p) r where k <= 5 group by 1, 2)
select e.source, e.target, weight, shared_subjects from e join s using (source, target) join t a on a.contact = source join t b on b.contact = target where weight >= 2 or (a.total >= 20 and b.total >= 20)"""


@query("graph_pipeline", "R2 K3 A4 A7", _EDGES)
def graph_pipeline(spark, sf_dir):
    cm = messages(spark, sf_dir)
    bundles = oc.contact_rollup(cm).select("*", F.lit(0).alias("pos"), F.lit(None).cast("string").alias("relationship_type"), F.lit("").alias("org"), F.lit("").alias("name"))
    return pipelines.relationship_graph(bundles, cm)["edges"].select("source", "target", "weight", "shared_subjects")


@query("graph_growth", "R2 J7 ST6", f"""
with cm as {_CM}, g as (select distinct lower(trim(subject)) as subject, contact from cm where length(trim(subject)) > 10),
ok as (select subject from g group by subject having count(*) between 2 and 20)
select a.contact as source, b.contact as target, count(*) as weight from g a join g b using (subject) where a.contact < b.contact and subject in (select subject from ok) group by 1, 2""")
def graph_growth(spark, sf_dir):
    """Weights of the earlier messages, changed by the later ones: the same as those of all at once."""
    cm = messages(spark, sf_dir)
    part = lambda cond: og.subject_members(cm.filter(cond), "subject", "contact")
    early, late = part("msg_id % 3 <> 1"), part("msg_id % 3 = 1")
    weights = og.edge_weights(og.cooccurrence_pairs(og.member_groups(early)))
    return og.changed_weights(weights, og.pair_changes(early, late))


@query("timeline_pipeline", "R3 W5 F15 F56", f"""
with cm as {_CM}, typed as (select *, {first_hit_sql("lower(subject || ' ' || substring(body, 1, 200))", rt.EVENT_RULES)} as event_type from cm),
d as (select *, row_number() over (partition by cast(ts as date), trim(regexp_replace(lower(subject), '^((re|fwd|fw):\\s*)+', '')) order by ts, contact, subject) as k from typed where event_type is not null)
select epoch_us(ts) as ts, contact as contact_email, subject, direction, event_type from d where k = 1""")
def timeline_pipeline(spark, sf_dir):
    events = pipelines.timeline(None, [OWN], messages(spark, sf_dir))["events"]
    return events.select("ts", "contact_email", "subject", "direction", "event_type")
