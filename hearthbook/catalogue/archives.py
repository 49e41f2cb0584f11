"""Archives written as their own files and read back, and whole pipelines over given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthbook.catalogue.activity import CHOICES, HAVE, MEDIA, NOTES, NOTES_DUCK, PICKS, WORKS, _CATEGORY, _FOLLOW, _PICKED, _PRO, _SCORE8, _TAGS, _WARM
from hearthbook.catalogue.base import REGISTRY, derive, query, table
from hearthbook.catalogue.mailbox import OWN, _CM, raw_messages
from hearthbook.catalogue.texts import CAST, PROSE_TOPICS, _SKIP_PROSE, _CAST, topics_sql, weighted_sql
from hearthbook.operators import chat as oc, lint, media as om, ordering as oo, sessions as os_
from hearthbook.plans import pipelines
from hearthbook.rulesets import ocr
from hearthbook.session import scratch_path
from hearthbook.sinks import writers as wr
from hearthbook.sources import archive as ar, mail, social
from hearthbook.streaming import flows

# -- files --------------------------------------------------------------------------------------


@query("mailbox_scan", "S1 F10 P1", r"""
select 'o' || o_orderkey || '@mail.example' as sender, 'Customer ' || o_custkey as sender_name, 'me@own.example|c' || o_custkey || '@mail.example' as recipients, epoch_us(o_orderdate) as ts,
  'Order ' || o_orderkey || case when o_orderkey % 3 = 0 then ' für' else '' end as subject, 'Hello,' || chr(10) || '>From here ' || o_orderpriority as body, case when o_orderkey % 5 = 0 then 'bulk' end as precedence from orders""")
def mailbox_scan(spark, sf_dir):
    """Orders as messages of a mailbox: encoded and folded headers, two recipients, lines that look like a new message."""
    o = table(spark, sf_dir, "orders")
    text = lambda c: F.col(c).cast("string")
    subject = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("=?utf-8?q?Order_"), text("o_orderkey"), F.lit("_f=C3=BCr?="))).otherwise(F.concat(F.lit("Order "), text("o_orderkey")))
    lines = [
        F.lit("From MAILER Mon Jan  1 00:00:00 2024"), F.concat(F.lit("Message-ID: <"), text("o_orderkey"), F.lit(">")),
        F.concat(F.lit("From: Customer "), text("o_custkey"), F.lit(" <O"), text("o_orderkey"), F.lit("@mail.example>")),
        F.concat(F.lit("To: me@own.example,\n C <c"), text("o_custkey"), F.lit("@mail.example>")), F.concat(F.lit("Subject: "), subject),
        F.concat(F.lit("Date: "), F.date_format("o_orderdate", "dd MMM yyyy HH:mm:ss"), F.lit(" +0000")),
        F.when(F.col("o_orderkey") % 5 == 0, F.lit("Precedence: bulk")), F.lit("Content-Type: text/plain; charset=utf-8"), F.lit(""),
        F.lit("Hello,"), F.concat(F.lit(">From here "), "o_orderpriority"),
    ]
    out = scratch_path(spark, "mailbox")
    o.select(F.array_join(F.filter(F.array(*lines), lambda x: x.isNotNull()), "\n").alias("value")).write.text(out)
    m = mail.read_mbox(spark, out)
    strip = F.regexp_replace("body", r"\s+$", "")
    return m.select("sender", "sender_name", F.transform("recipients", lambda r: r["addr"]).alias("recipients"), "ts", "subject", strip.alias("body"), "precedence")


def _note_folder(spark, sf_dir):
    """Notes with frontmatter and aliases, one file each; pages that share a path are one note, that of the least page."""
    n = derive(spark, sf_dir, NOTES)
    first = n.groupBy("path").agg(F.min(F.struct("title", "type", "status", "last_updated", "body")).alias("n")).select("path", "n.*")
    front = F.concat_ws("\n", F.lit("---"), F.concat(F.lit("type: "), "type"), F.concat(F.lit('status: "'), "status", F.lit('"')),
                        F.concat(F.lit("last_updated: "), F.date_format("last_updated", "yyyy-MM-dd")),
                        F.concat(F.lit("aliases: [Old "), "title", F.lit(", 'The "), "title", F.lit("']")), F.lit("---"), F.lit(""))
    out = scratch_path(spark, "vault")
    wr.write_named(first.select(F.col("path").alias("name"), F.concat(front, "body").alias("text")), out)
    return out


_NOTE = f"(select path, min((title, type, status, last_updated, body)) as n from ({NOTES_DUCK}) x group by path)"


@query("note_files", "S19", f"""
select path, n[1] as title, n[2] as type, n[3] as status, strftime(n[4], '%Y-%m-%d') as last_updated, length(n[5]) as chars from {_NOTE} t""")
def note_files(spark, sf_dir):
    out = _note_folder(spark, sf_dir)
    n = ar.read_notes(spark, out, out)
    return n.select("path", "title", "type", "status", F.date_format("last_updated", "yyyy-MM-dd").alias("last_updated"), F.length("body").alias("chars"))


@query("note_file_links", "S19 J16", f"""
select distinct path as src, split_part(raw, '|', 1) as target from (select path, unnest(regexp_extract_all(n[5], '\\[\\[([^\\]]+)\\]\\]', 1)) as raw from {_NOTE} t) r where split_part(raw, '|', 1) <> ''""")
def note_file_links(spark, sf_dir):
    out = _note_folder(spark, sf_dir)
    return lint.note_links(ar.read_notes(spark, out, out))


@query("people_files", "S6", f"""
select page, name from (select n[1] as page, unnest([n[1], 'Old ' || n[1], 'The ' || n[1]]) as name from {_NOTE} t) p""")
def people_files(spark, sf_dir):
    out = _note_folder(spark, sf_dir)
    return ar.page_names(ar.read_people_notes(spark, out, out)).select("page", "name")


@query("dictionary_files", "S21", f"select lower(d) as key, min(d) as display from (select substr(n[1], 2) as d from {_NOTE} t) x where length(d) >= 2 group by 1")
def dictionary_files(spark, sf_dir):
    out = _note_folder(spark, sf_dir)
    return ar.read_name_dictionary(ar.read_notes(spark, out, out), prefix="N", min_len=2)


SAID = "select conv_id || '-' || turn as stem, 'm' || conv_id % 12 as month, role as old_category, coalesce(text, '') as text from conversations"


def _ocr_folder(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    name = F.concat("role", F.lit("/m"), F.col("conv_id") % 12, F.lit("/"), "conv_id", F.lit("-"), "turn", F.lit(".txt"))
    out = scratch_path(spark, "ocr")
    wr.write_named(c.select(name.alias("name"), "text"), out)
    return out


@query("ocr_files", "S14", f"select stem, month, old_category, sha256(text) as digest from ({SAID}) s")
def ocr_files(spark, sf_dir):
    return ar.read_ocr_text(spark, _ocr_folder(spark, sf_dir)).select("stem", "month", "old_category", F.sha2("text", 256).alias("digest"))


@query("stream_texts", "ST1 ST3", weighted_sql(ocr.DETAILED_RULES, "Uncategorized", 5, "Unreadable", ocr.FALLBACK_RULES, ocr.AS_WRITTEN_WEIGHT, cols="stem").replace(
    "from documents", f"from ({SAID}) documents where text <> ''"))
def stream_texts(spark, sf_dir):
    """New text files as a stream: empty ones wait, each is classified once with its entities and appended."""
    inbox, out = _ocr_folder(spark, sf_dir), scratch_path(spark, "classified")
    with flows.quick_look_up(spark, inbox):
        flows.stream_classify(spark, inbox, f"{out}/rows", f"{out}/log", kinds=["emails"]).awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("stem", "category", "score")


@query("picker_files", "S17 J9 A31", f"""
with f as (select distinct h.work_id, filename from ({HAVE}) h) select coalesce(s.work_id, w.work_id) as work_id, choice,
  case when choice = '__SKIP__' then 'skipped' when s.work_id is null then 'pending' when w.work_id is null then 'unknown_work' when f.work_id is null then 'missing_file' else 'picked' end as status
from ({CHOICES}) s full join ({WORKS}) w on s.work_id = w.work_id left join f on f.work_id = s.work_id and f.filename = choice""")
def picker_files(spark, sf_dir):
    """Picker exports, one document per group of works, written and read back."""
    group = F.pmod(F.xxhash64("work_id"), F.lit(20)).alias("g")
    s = derive(spark, sf_dir, CHOICES).select(group, F.struct("work_id", "choice").alias("c")).groupBy("g").agg(F.map_from_entries(F.collect_list("c")).alias("selections"))
    have = derive(spark, sf_dir, HAVE).groupBy("work_id").agg(F.collect_set("filename").alias("files"))
    w = derive(spark, sf_dir, WORKS).join(have, "work_id", "left")
    files = F.transform(F.coalesce("files", F.array()), lambda f: F.struct(f.alias("filename"), F.lit(1).alias("bytes")))
    w = w.select(group, F.struct(F.col("work_id").alias("id"), F.concat(F.lit("x/"), "work_id").alias("rel_path"), files.alias("candidates")).alias("w")).groupBy("g").agg(F.collect_list("w").alias("works"))
    docs = s.join(w, "g", "full").select(F.concat(F.lit("picks-"), "g", F.lit(".json")).alias("name"), F.to_json(F.struct("selections", "works")).alias("text"))
    out = scratch_path(spark, "picks")
    wr.write_named(docs, out)
    chosen, works = ar.read_selections(spark, out)
    files = works.select("work_id", F.explode("candidates.filename").alias("filename"))
    return om.apply_selections(chosen, works.select("work_id"), files)


# -- pipelines ----------------------------------------------------------------------------------


@query("cast_pipeline", "R4", f"""
select primary_era, narrative_function, rank, email from (select *, row_number() over (partition by primary_era, narrative_function order by total_emails desc, email) as rank from ({_CAST}) c) r where rank <= 30""")
def cast_pipeline(spark, sf_dir):
    return pipelines.cast(derive(spark, sf_dir, CAST), ["c1@mail.example"])["shown"].select("primary_era", "narrative_function", "rank", "email")


_SHOTS = f"""
select m.id, {_CATEGORY} as category, o_orderdate + to_seconds(m.id % 7 * 1500) as taken_at from ({MEDIA}) m join {{orders}} on o_orderkey = m.id"""


@query("media_pipeline", "R8 W3 W4", f"""
with s as ({_SHOTS.replace('{orders}', 'orders')}), k as (select * from s where category in ('Photos', 'Videos')),
g as (select *, case when epoch_us(taken_at) - epoch_us(lag(taken_at) over (order by taken_at, id)) <= 7200000000 then 0 else 1 end as fresh from k),
n as (select *, sum(fresh) over (order by taken_at, id rows between unbounded preceding and current row) as no from g),
e as (select min(taken_at) as session_start, max(taken_at) as session_end, count(*) as members, count(*) filter (category <> 'Videos') as photos from n group by no having count(*) >= 3)
select epoch_us(session_start) as session_start, epoch_us(session_end) as session_end, members, photos, row_number() over (order by session_start) as event_no from e""")
def media_pipeline(spark, sf_dir):
    m = derive(spark, sf_dir, MEDIA).join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_orderdate"), "id")
    at = (F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("id") % 7 * 1500).cast("decimal(18,6)"))).cast("timestamp_ntz")
    m = m.withColumn("taken_at", at).withColumn("path", F.concat(F.lit("/m/"), F.col("id"))).withColumn("name", F.concat(F.lit("f"), F.col("id") % 40, "ext"))
    out = pipelines.media_organisation(m.withColumn("lat", F.lit(None).cast("double")).withColumn("lon", F.lit(None).cast("double")))
    return out["events"].select("session_start", "session_end", "members", "photos", "event_no")


@query("media_places", "R8 W11 A21", f"""
with s as (select *, strftime(taken_at, '%Y-%m') as month from ({_SHOTS.replace('{orders}', 'orders')}) s join (select id as i, 'f' || id % 40 as stem, ext from ({MEDIA}) m) x on x.i = s.id),
r as (select *, row_number() over (partition by category, month, stem, ext order by taken_at, '/m/' || id) as n from s)
select id, category || '/' || month as dest_dir, stem || case when n = 1 then '' else '_' || (n - 1) end || ext as dest_name from r""")
def media_places(spark, sf_dir):
    m = derive(spark, sf_dir, MEDIA).join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_orderdate"), "id")
    at = (F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("id") % 7 * 1500).cast("decimal(18,6)"))).cast("timestamp_ntz")
    m = m.withColumn("taken_at", at).withColumn("path", F.concat(F.lit("/m/"), F.col("id"))).withColumn("name", F.concat(F.lit("f"), F.col("id") % 40, "ext"))
    out = pipelines.media_organisation(m.withColumn("lat", F.lit(None).cast("double")).withColumn("lon", F.lit(None).cast("double")))
    return out["placed"].select("id", "dest_dir", "dest_name")


@query("hero_pipeline", "R11 W12", f"select work, name, cast(score as bigint) as score, row_number() over (partition by work order by score desc, name) as rank from (select h.*, p.name from ({_PICKED}) h join (select id as i, name from ({PICKS}) q) p on p.i = h.id) h")
def hero_pipeline(spark, sf_dir):
    files = derive(spark, sf_dir, PICKS).withColumn("work_id", F.col("work"))
    works = files.select("work_id").distinct()
    chosen = works.select("work_id", F.lit("__SKIP__").alias("choice"))
    return pipelines.hero_selection(files, works, chosen)["ranked"].select("work", "name", "score", "rank")


@query("chat_pipeline", "R6 F48", r"""
with t as (select conv_id, turn, role, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') as said from conversations),
c as (select conv_id, count(*) filter (said <> '') as message_count, max(case when turn = 0 then said end) as title from t group by conv_id)
select conv_id, message_count, unnest({topics}) as domain from c where message_count >= 3 and not regexp_matches(lower(title), '(?:^the\b)|(?:queque$)')""".replace("{topics}", topics_sql("lower(title)", PROSE_TOPICS)))
def chat_pipeline(spark, sf_dir):
    """Topics of conversations read from one exported array."""
    c = table(spark, sf_dir, "conversations")
    key = lambda t: F.concat(F.lit("n"), t.cast("string"))
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", "")
    said = F.struct(F.struct("role").alias("author"), F.struct(F.lit("text").alias("content_type"), F.array(text).alias("parts")).alias("content"))
    node = F.struct(key(F.col("turn")).alias("id"), F.when(F.col("turn") > 0, key(F.col("turn") - 1)).alias("parent"), said.alias("message"))
    rows = c.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct(key(F.col("turn")), node))).alias("mapping"), F.max("turn").alias("last"),
                                    F.max(F.when(F.col("turn") == 0, text)).alias("title"))
    export = F.to_json(F.struct("title", (F.col("conv_id") * 86400).cast("double").alias("create_time"), key(F.col("last")).alias("current_node"), "mapping"))
    out = scratch_path(spark, "export")
    wr.write_named(rows.groupBy(F.pmod("conv_id", F.lit(8)).alias("g")).agg(F.collect_list(export).alias("all")).select(
        F.concat(F.lit("chat-"), "g", F.lit(".json")).alias("name"), F.concat(F.lit("["), F.array_join("all", ",\n"), F.lit("]")).alias("text")), out)
    walked = oc.summarise_chat(oc.current_path(ar.read_chat_export(spark, out)))
    found = oc.topic_index(walked, PROSE_TOPICS, _SKIP_PROSE)
    return found.select(F.datediff(F.to_date("date"), F.lit("1970-01-01").cast("date")).cast("bigint").alias("conv_id"), "message_count", "domain")


_CHECKS = ["broken_links", "stub_notes", "duplicate_notes", "orphan_notes", "missing_frontmatter", "status_mismatch", "naming_violations",
           "concepts_without_page", "stale_notes", "underlinked_notes"]


@query("lint_pipeline", "R12", " union all ".join(f"select \"check\", path, detail from ({REGISTRY[c].sql}) q" for c in _CHECKS).replace("coalesce(o.n, 0) < 3", "coalesce(o.n, 0) < 2"))
def lint_pipeline(spark, sf_dir):
    return pipelines.vault_lint(derive(spark, sf_dir, NOTES), "2024-07-01", {"canon": "^N[0-4]", "output": "[02468]$"})


@query("media_listing", "S15 S16", """
select 'f' || p_partkey || case p_partkey % 3 when 0 then '.png' when 1 then '.PNG' else '.jpg' end as name, case p_partkey % 3 when 2 then '.jpg' else '.png' end as ext,
  24 + p_partkey % 5 as length, case when p_partkey % 3 < 2 and p_partkey % 7 > 0 then cast(p_size * 100 as bigint) end as width, case when p_partkey % 3 < 2 and p_partkey % 7 > 0 then p_partkey end as height from part""")
def media_listing(spark, sf_dir):
    """Files with image headers, some broken, listed with the sizes that their first bytes give."""
    part = table(spark, sf_dir, "part")
    hexed = lambda c, n: F.lpad(F.hex(c), n, "0")
    head = F.when(F.col("p_partkey") % 7 > 0, F.lit("89504E470D0A1A0A")).otherwise(F.lit("0" * 16))
    raw = F.concat(head, F.lit("0000000D49484452"), hexed(F.col("p_size") * 100, 8), hexed(F.col("p_partkey"), 8), F.repeat(F.lit("00"), (F.col("p_partkey") % 5).cast("int")))
    ext = F.when(F.col("p_partkey") % 3 == 0, ".png").when(F.col("p_partkey") % 3 == 1, ".PNG").otherwise(".jpg")
    name = F.concat(F.lit("b"), F.col("p_partkey") % 20, F.lit("/f"), "p_partkey", ext)
    out = scratch_path(spark, "media")
    wr.write_named(part.select(name.alias("name"), F.unhex(raw).alias("text")), out)
    found = ar.list_media(spark, out, with_size=True)
    png = F.lower("ext") == ".png"
    return found.select("name", "ext", "length", F.when(png, F.col("width")).alias("width"), F.when(png, F.col("height")).alias("height"))


@query("message_notes", "S11", r"""
with t as (select conv_id, turn, role, 'm' || length(coalesce(text, '')) as said from conversations)
select 'note ' || conv_id || '.md' as name, 'assistant|user' as participants, count(*) as message_count, string_agg(said, '|' order by turn) filter (role = 'user') as own,
  string_agg(said, '|' order by turn) filter (role <> 'user') as others, 'March ' || (1 + conv_id % 28) || ', 2024' as day from t group by conv_id""")
def message_notes(spark, sf_dir):
    """Threads rendered as notes and read back: participants, counts, days and both sides' messages."""
    c = table(spark, sf_dir, "conversations")
    line = F.concat(F.lit("**"), F.when(F.col("role") == "user", F.col("role")).otherwise(F.concat(F.lit("[["), "role", F.lit("]]"))), F.lit("** (10:00):\n> m"), F.length(F.coalesce("text", F.lit(""))))
    said = F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"])
    day = F.concat(F.lit("## March "), 1 + F.col("conv_id") % 28, F.lit(", 2024"))
    notes = c.groupBy("conv_id").agg(said.alias("said")).select(
        F.concat(F.lit("note "), "conv_id", F.lit(".md")).alias("name"),
        F.concat(F.lit('---\nparticipants: ["assistant", "user"]\nmessage_count: '), F.size("said"), F.lit("\n---\n# T\n\n"), day, F.lit("\n\n"), F.array_join("said", "\n\n"), F.lit("\n")).alias("text"))
    out = scratch_path(spark, "threads")
    wr.write_named(notes, out)
    n = social.read_message_notes(spark, out, "user")
    return n.select(F.try_url_decode(F.substring_index("path", "/", -1)).alias("name"), "participants", "message_count", F.when(F.size("owner_messages") > 0, F.col("owner_messages")).alias("own"),
                    F.when(F.size("other_messages") > 0, F.col("other_messages")).alias("others"), F.col("first_date").alias("day"))


_DETAILED = weighted_sql(ocr.DETAILED_RULES, "Uncategorized", 5, "Unreadable", ocr.FALLBACK_RULES, ocr.AS_WRITTEN_WEIGHT)


@query("ocr_pipeline", "R7 A10 F20", f"select category, count(*) as n, round(count(*) * 100 / (sum(count(*)) over ())::double, 1) as percent from ({_DETAILED}) p group by category")
def ocr_pipeline(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("stem"), F.col("lang").alias("month"), F.coalesce("text", F.lit("")).alias("text"))
    merge = spark.createDataFrame([], "alias string, canonical string")
    return pipelines.ocr_knowledge(d, merge, "2024-01-01")["share"]


_MASTER = f"""
with cm as {_CM}, c as (select contact as email, count(*) as total_emails, count(*) filter (direction = 'from') as emails_from, count(*) filter (direction = 'to') as emails_to,
  min(ts) as first_contact, max(ts) as last_contact from cm group by contact),
names as (select contact as email, shown, row_number() over (partition by contact order by length(shown) desc, shown) as k from (select distinct contact, shown from cm) d)
select c.email, case when s_suppkey % 2 = 0 then 'Book ' || s_suppkey else shown end as name, total_emails, emails_from, emails_to, epoch_us(first_contact) as first_contact, epoch_us(last_contact) as last_contact,
  date_diff('day', last_contact, timestamp '2002-01-01') as communication_gap_days, cast(round_even(least(100, greatest(0, least(15, log2(total_emails) * 15 / log2(500))
   + least(1, greatest(0, 1 - date_diff('day', last_contact, timestamp '2002-01-01') / 730.0)) * 40 + case when emails_from > 0 and emails_to > 0
     then least(emails_from, emails_to) / greatest(emails_from, emails_to) * 45 when emails_from > 0 or emails_to > 0 then 10 else 0 end)), 0) as bigint) as relationship_strength,
  s_suppkey % 3 = 0 as has_enrichment, case when s_suppkey % 3 = 0 then 'press' end as relationship_type
from c join names using (email) join supplier on email = 's' || s_suppkey || '@mail.example' where k = 1"""


@query("master_pipeline", "R1 A1 J1 J2 J3 F25 F26 F46", _MASTER)
def master_pipeline(spark, sf_dir):
    """Messages to master rows: bundles, page match, address book, customer list, enrichment, strength."""
    shaped, known = raw_messages(spark, sf_dir)
    who = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.concat(F.lit("s"), "s_suppkey", F.lit("@mail.example")).alias("email"))
    none = lambda *names: [F.lit(None).cast("string").alias(n) for n in names]
    book = who.filter("k % 2 = 0").select("email", F.concat(F.lit("Book "), "k").alias("gc_name"), *none(
        "gc_phone", "gc_org", "gc_title", "gc_city", "gc_region", "gc_website", "gc_birthday"))
    crm = who.filter("k % 5 = 1").select("email", *none("crm_name", "crm_phone", "crm_city", "crm_state", "crm_collector_type", "crm_priority", "crm_net_sales", "crm_products"))
    results = who.filter("k % 3 = 0").select("email", F.lit("press").alias("relationship_type"), *none(
        "role_title", "relationship_summary", "notable_context", "communication_style", "error"), *[F.array().cast("array<string>").alias(n) for n in ("key_topics", "projects_in_common")])
    pages = spark.createDataFrame([("Nobody Known", "Nobody Known", 0)], "page string, name string, rank int")
    m = pipelines.contact_360(shaped, known, [OWN], book, crm, pages, results, "2002-01-01", "a")
    return m.select("email", "name", "total_emails", "emails_from", "emails_to", "first_contact", "last_contact", "communication_gap_days", "relationship_strength", "has_enrichment", "relationship_type")


@query("social_pipeline", "R5 W8 P13", f"""
select 'n' || conv_id as name, score, rank, cast(case when rank <= 25 then 1 when rank <= 60 then 2 else 3 end as bigint) as tier
from (select conv_id, score, row_number() over (order by score desc, 'n' || conv_id) as rank from ({_SCORE8}) s where conv_id % 5 <> 0) r where rank <= 100""")
def social_pipeline(spark, sf_dir):
    """Ranking of contacts from threads of up to three people, known from their pages."""
    c = table(spark, sf_dir, "conversations")
    name = F.concat(F.lit("n"), "conv_id")
    people = F.when(F.col("conv_id") % 5 == 0, F.array(*[F.lit(x) for x in "abcd"])).otherwise(F.array(name))
    m = c.select(name.alias("name"), F.when(F.col("role") == "assistant", "me").otherwise("them").alias("author"), F.col("text").alias("body"),
                 F.col("conv_id").alias("thread_id"), F.col("turn").alias("pos"), F.lit(None).cast("timestamp_ntz").alias("ts"), people.alias("participants"))
    pages = c.filter("conv_id % 3 = 0").select(name.alias("title"))
    out = pipelines.social_ranking(m, "me", pages, professional=_PRO, warmth=_WARM, followup=_FOLLOW, tags=_TAGS)
    return out["ranking"].select("name", "score", "rank", "tier")
