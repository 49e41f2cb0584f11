"""Queries on social activity, chats, sessions, media, files, picking, press and notes."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthbook.catalogue.base import derive, query, sql_list, sql_text, table
from hearthbook.functions import dates as fd, media as fm, scores as sc, text as ft
from hearthbook.operators import chat as oc, lint, media as om, ordering as oo, press as op, reports, sessions as os_, social as so
from hearthbook.rulesets import files as fr

# -- social: conversations are threads, events are posts ---------------------------------------

POSTS = "select 'u' || cast(user_id as varchar(20)) as author, event_id as post, ts, event_type from {events}"
COMMENTS = "select 'u' || cast((user_id * 7 + event_id) % 160 as varchar(20)) as author, event_id as post from {events} where event_type = 'click'"
TURNS = "select conv_id, turn, case when role = 'user' then 'u' || cast(conv_id % 150 as varchar(20)) when role = 'assistant' then 'me' else 'Unknown' end as author, text from {conversations}"


@query("people_counts", "A13", f"""
with sizes as (select conv_id, count(*) as messages from ({TURNS}) t group by conv_id),
s as (select author as person, 1 as n from ({POSTS}) p where author <> 'u1' union all select author, 1 from ({COMMENTS}) c where author <> 'u1'
  union all select distinct_people.author, messages from (select distinct conv_id, author from ({TURNS}) t where author not in ('me', 'Unknown')) distinct_people join sizes using (conv_id))
select person, cast(sum(n) as bigint) as appearances from s where person <> 'Unknown' group by person""")
def people_counts(spark, sf_dir):
    sizes = so.thread_sizes(derive(spark, sf_dir, TURNS), "conv_id", "author", "me").select("person", "messages")
    return so.people_counts(derive(spark, sf_dir, POSTS), derive(spark, sf_dir, COMMENTS), sizes, "u1")


THREADS = """
select l_orderkey as thread, l_suppkey % 9 as person, l_shipdate as ts, l_linenumber from {lineitem}"""
_THREADS = f"""
select thread, list_sort(list(distinct 'p' || person)) as people, count(*) as messages, min(ts) as first_ts, max(ts) as last_ts from ({THREADS}) t where person <> 0 group by thread"""


def _threads(spark, sf_dir):
    t = derive(spark, sf_dir, THREADS).filter("person <> 0").withColumn("p", F.concat(F.lit("p"), "person"))
    return t.groupBy("thread").agg(F.collect_set("p").alias("participants"), F.count(F.lit(1)).alias("messages"),
                                   F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("merged_threads", "A15 P13", f"""
select array_to_string(people, ', ') as name, cast(sum(messages) as bigint) as messages, count(*) as threads, epoch_us(min(first_ts)) as first_ts, epoch_us(max(last_ts)) as last_ts
from ({_THREADS}) t where len(people) <= 3 group by 1""")
def merged_threads(spark, sf_dir):
    return so.merge_threads(so.one_to_few(_threads(spark, sf_dir)))


@query("person_threads", "J18", f"select person, count(*) as threads from (select unnest(people) as person from ({_THREADS}) t) p group by person")
def person_threads(spark, sf_dir):
    return so.person_threads(_threads(spark, sf_dir), "thread").groupBy("person").agg(F.count(F.lit(1)).alias("threads"))


@query("posts_by_period", "A14 F41", """
select strftime(o_orderdate, '%Y') as year, strftime(o_orderdate, '%Y-%m') as month, count(*) as posts from {orders} group by rollup (1, 2)""")
def posts_by_period(spark, sf_dir):
    return so.posts_by_period(table(spark, sf_dir, "orders"), "o_orderdate")


@query("top_people_per_year", "W16", """
select * from (select year(o_orderdate) as year, o_custkey as person, count(*) as posts, row_number() over (partition by year(o_orderdate) order by count(*) desc, o_custkey) as rank from {orders} group by 1, 2) r where rank <= 15""")
def top_people_per_year(spark, sf_dir):
    return so.top_people_per_year(table(spark, sf_dir, "orders"), "o_orderdate", "o_custkey")


_PERSON_POSTS = f"""
select distinct p.author as person, post, ts from ({POSTS}) p union select c.author, c.post, p.ts from ({COMMENTS}) c join ({POSTS}) p using (post)"""


@query("person_month_activity", "J20 A35", f"select person, strftime(ts, '%Y-%m') as month, count(*) as posts from ({_PERSON_POSTS}) p group by 1, 2")
def person_month_activity(spark, sf_dir):
    c = derive(spark, sf_dir, COMMENTS).groupBy("post").agg(F.collect_list(F.struct("author")).alias("comments"))
    p = derive(spark, sf_dir, POSTS).join(c, "post", "left")
    p = p.withColumn("comments", F.coalesce("comments", F.array().cast("array<struct<author:string>>")))
    return so.person_month_activity(so.person_posts(p, "post"))


_PRO, _WARM, _FOLLOW = ["eau", "tion", "sch", "ung ", "ción", "the "], ["queque", "leau", "of"], ["ando", "er e", "pour"]
_TAGS = {"Romance": ["eau", "ción"], "Germanic": ["sch", "the "]}


def _present(words, col="l"):
    return f"(select count(*) from (select unnest({sql_list(words)}) as k) x where contains({col}, k))"


def _any_word(words):
    return f"(select bool_or(contains(lower(m.text), k)) from (select unnest({sql_list(words)}) as k) x)"


_SCORE8 = f"""
with m as (select *, role = 'assistant' as own from conversations),
kw as (select conv_id, count(distinct k) filter (where g = 'p') as p, count(distinct k) filter (where g = 'w') as w, count(distinct k) filter (where g = 'f') as f
  from m, (select unnest({sql_list(_PRO)}) as k, 'p' as g union all select unnest({sql_list(_WARM)}), 'w' union all select unnest({sql_list(_FOLLOW)}), 'f') q where contains(lower(text), k) group by conv_id),
tg as (select conv_id, {", ".join(f"bool_or({_any_word(w)}) as t{i}" for i, w in enumerate(_TAGS.values()))} from m group by conv_id),
b as (select conv_id, text, row_number() over (partition by conv_id order by own, length(text) desc, turn) as k from m where length(text) < 300),
a as (select conv_id, count(*) as messages, count(*) filter (where own) as own, count(*) filter (where not own) as other, sum(length(text)) / count(*)::double as mean from m group by conv_id),
s as (select a.conv_id, messages, case when messages >= 30 then 20 when messages >= 20 then 15 when messages >= 10 then 10 when messages >= 5 then 5 else 2 end as depth,
  cast(floor(least(own, other) / greatest(own, other, 1)::double * 15) as bigint) as reciprocity, least(coalesce(p, 0) * 2, 25) as professional, least(coalesce(w, 0) * 3, 15) as warmth,
  least(coalesce(f, 0) * 3, 15) as followup_intent, 1 as recency, case when a.conv_id % 3 = 0 then 5 else 0 end as wall_presence,
  case when mean > 100 then 10 when mean > 50 then 6 when mean > 20 then 3 else 0 end as substance, coalesce(b.text, '') as best, t0, t1
  from a left join kw using (conv_id) left join tg using (conv_id) left join b on b.conv_id = a.conv_id and b.k = 1)
select conv_id, messages, cast(depth as bigint) as depth, reciprocity, professional, warmth, followup_intent, cast(wall_presence as bigint) as wall_presence, cast(substance as bigint) as substance,
  cast(depth + reciprocity + professional + warmth + followup_intent + recency + wall_presence + substance as bigint) as score,
  coalesce(nullif(concat_ws('|', case when professional >= 10 then 'Professional' end, case when warmth >= 6 then 'Personal' end, case when followup_intent >= 6 then 'Reconnect' end, case when t0 then 'Romance' end, case when t1 then 'Germanic' end), ''), 'General') as tags,
  replace(case when length(best) > 150 then substring(best, 1, 147) || '...' else best end, chr(10), ' ') as snippet from s"""


def _score8(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    wall = c.filter(F.col("conv_id") % 3 == 0).select("conv_id")
    return so.contact_score(c, "conv_id", F.col("role") == "assistant", "text", ["turn"], present=wall,
                            professional=_PRO, warmth=_WARM, followup=_FOLLOW, tags=_TAGS)


@query("contact_score8", "F27 F28 F29", _SCORE8)
def contact_score8(spark, sf_dir):
    return _score8(spark, sf_dir).drop("recency")


@query("contact_tiers", "W8 K8", f"""
select conv_id, score, rank, cast(case when rank <= 25 then 1 when rank <= 60 then 2 else 3 end as bigint) as tier from (select conv_id, score, row_number() over (order by score desc, conv_id) as rank from ({_SCORE8}) s) r where rank <= 100""")
def contact_tiers(spark, sf_dir):
    return so.contact_ranking(_score8(spark, sf_dir), "conv_id").select("conv_id", "score", "rank", "tier")


@query("contact_tag_counts", "A28", f"select tag, count(*) as contacts from (select unnest(string_split(tags, '|')) as tag from ({_SCORE8}) s) t group by tag")
def contact_tag_counts(spark, sf_dir):
    return so.tag_counts(_score8(spark, sf_dir))


@query("day_markers", "W15 L3", """
select event_id, row_number() over (partition by user_id, cast(ts as date) order by ts, event_id) = 1 as new_day from {events}""")
def day_markers(spark, sf_dir):
    return oo.day_marker(table(spark, sf_dir, "events"), "ts", ["user_id"], ["event_id"]).select("event_id", "new_day")


# -- chat ---------------------------------------------------------------------------------------

# Odd turns past the second hang below the turn before the last: branches off the current path.
NODES = "select conv_id, turn as node, case when turn = 0 then null when turn > 2 and turn % 2 = 1 then turn - 2 else turn - 1 end as up from {conversations}"


@query("chat_path_walk", "F47 W14", f"""
with recursive n as (select * from ({NODES}) n), walk as (
  select conv_id, node, up, 0 as d from n where (conv_id, node) in (select (conv_id, max(node)) from n group by conv_id)
  union all select n.conv_id, n.node, n.up, d + 1 from walk join n on n.conv_id = walk.conv_id and n.node = walk.up)
select conv_id, node, cast(max(d) over (partition by conv_id) - d as bigint) as pos from walk""")
def chat_path_walk(spark, sf_dir):
    n = derive(spark, sf_dir, NODES)
    current = n.groupBy("conv_id").agg(F.max("node").alias("node"))
    return oc.path_rows(n, "conv_id", "node", "up", current)


_CUT = "case when length({0}) > {1} then substring({0}, 1, {1}) || '...' else {0} end"


@query("chat_summary", "F48", f"""
select conv_id, count(*) as message_count, count(*) filter (where role = 'user') as user_messages, coalesce(cast(sum(length({_CUT.format('text', 2000)})) filter (where role = 'user') as bigint), 0) as user_chars,
  first({_CUT.format('text', 1500)} order by turn) filter (where role = 'assistant') as first_reply,
  case when count(*) filter (where role = 'assistant') > 1 then last({_CUT.format('text', 1500)} order by turn) filter (where role = 'assistant') end as last_reply from conversations group by conv_id""")
def chat_summary(spark, sf_dir):
    return oc.summarise_rows(table(spark, sf_dir, "conversations"), "conv_id", "turn")


# -- sessions -----------------------------------------------------------------------------------

def sessions_sql(keys: str) -> str:
    part = f"partition by {keys} " if keys else ""
    k = f"{keys}, " if keys else ""
    return f"""
select *, max(case when fresh then ts end) over ({part}order by ts rows between unbounded preceding and current row) as session_start from (
  select {k}event_id, ts, event_type, value, coalesce(epoch_us(ts) - epoch_us(lag(ts) over ({part}order by ts)) > 7200000000, true) as fresh from events) e"""


_SUMMARY = f"""
select user_id, epoch_us(session_start) as session_start, epoch_us(max(ts)) as session_end, count(*) as members, count(*) filter (where event_type <> 'click') as photos, count(*) filter (where event_type = 'click') as videos,
  round(avg(value), 6) as mean_lat, round(avg(-value), 6) as mean_lon, case when epoch_us(max(ts)) - epoch_us(session_start) >= 3600000000 then cast((epoch_us(max(ts)) - epoch_us(session_start)) // 3600000000 as varchar) || 'h ' else '' end
  || cast((epoch_us(max(ts)) - epoch_us(session_start)) % 3600000000 // 60000000 as varchar) || 'm' as duration
from ({sessions_sql('user_id')}) s group by user_id, s.session_start having count(*) >= 3"""


@query("sessionize", "W3", f"select event_id, epoch_us(session_start) as session_start from ({sessions_sql('user_id')}) s")
def sessionize(spark, sf_dir):
    return os_.sessionize(table(spark, sf_dir, "events"), "ts", 7200, ["user_id"]).select("event_id", "session_start")


@query("sessionize_all", "W3", f"select event_id, epoch_us(session_start) as session_start from ({sessions_sql('').replace('7200000000', '300000000')}) s")
def sessionize_all(spark, sf_dir):
    return os_.sessionize(table(spark, sf_dir, "events"), "ts", 300).select("event_id", "session_start")


def _events(spark, sf_dir):
    s = os_.sessionize(table(spark, sf_dir, "events"), "ts", 7200, ["user_id"]).withColumn("lon", -F.col("value"))
    photo = F.col("event_type") != "click"
    return os_.event_summary(s, "ts", ["user_id"], 3, photo, ~photo, "value", "lon")


@query("event_summary", "A20 F40", _SUMMARY)
def event_summary(spark, sf_dir):
    return _events(spark, sf_dir).withColumn("mean_lat", F.round("mean_lat", 6)).withColumn("mean_lon", F.round("mean_lon", 6))


@query("event_numbers", "W4", f"select user_id, session_start, row_number() over (partition by user_id order by session_start) as event_no from ({_SUMMARY}) e")
def event_numbers(spark, sf_dir):
    return os_.number_events(_events(spark, sf_dir), ["user_id"]).select("user_id", "session_start", "event_no")


@query("largest_events", "L4", f"select user_id, session_start, members from ({_SUMMARY}) e order by members desc, session_start limit 10")
def largest_events(spark, sf_dir):
    return os_.largest_events(_events(spark, sf_dir)).select("user_id", "session_start", "members")


# -- media --------------------------------------------------------------------------------------

MEDIA = """
select p_partkey as id, case p_partkey % 8 when 0 then '.png' when 1 then '.PNG' when 2 then '.heic' when 3 then '.jpg' when 4 then '.mov' when 5 then '.gif' when 6 then '.txt' else '.jpeg' end as ext,
  case when p_size % 5 = 0 then 1170 when p_size % 5 = 1 then 2532 else p_size * 40 end as width, case when p_size % 5 = 0 then 2532 when p_size % 5 = 1 then 1170 else p_size * 75 end as height,
  p_partkey % 3 = 0 as has_camera, p_size as num_faces, p_retailprice as v from {part}"""
_SIZES = [f"{w}x{h}" for w, h in fr.SCREEN_SIZES] + [f"{h}x{w}" for w, h in fr.SCREEN_SIZES]
_SHOT = f"""(lower(ext) not in ('.heic', '.heif', '.mov') and not has_camera and (list_contains({sql_list(_SIZES)}, width || 'x' || height)
  or (lower(ext) = '.png' and ((width > 700 and height > 1200 and height / width::double > 1.5 and height / width::double < 2.5) or (height > 700 and width > 1200 and width / height::double > 1.5 and width / height::double < 2.5)))))"""
_CATEGORY = f"""case when lower(ext) = '.mov' then 'Videos' when lower(ext) = '.txt' then 'Other' when {_SHOT} then 'Screenshots' when lower(ext) = '.heic' then 'Photos'
  when lower(ext) in ('.jpg', '.jpeg') and has_camera then 'Photos' when lower(ext) in ('.jpg', '.jpeg', '.png') then 'Saved_Images' when has_camera then 'Photos' else 'Other' end"""


@query("media_category", "P22 P23", f"select id, {_SHOT} as screenshot, {_CATEGORY} as category from ({MEDIA}) m")
def media_category(spark, sf_dir):
    m = om.with_category(derive(spark, sf_dir, MEDIA))
    return m.select("id", fm.is_screenshot(F.col("ext"), F.col("width"), F.col("height"), F.col("has_camera")).alias("screenshot"), "category")


@query("media_stats", "A21 A22", f"""
select c.category, strftime(o_orderdate, '%Y-%m') as month, count(*) as files from (select id, {_CATEGORY} as category from ({MEDIA}) m) c join orders on o_orderkey = id group by 1, 2""")
def media_stats(spark, sf_dir):
    m = om.with_category(derive(spark, sf_dir, MEDIA))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("taken_at"))
    return om.media_stats(m.join(o, "id"))


@query("face_histogram", "A22", f"select num_faces, count(*) as images from ({MEDIA}) m group by 1".replace("select num_faces,", "select cast(num_faces as bigint) as num_faces,"))
def face_histogram(spark, sf_dir):
    return om.face_histogram(derive(spark, sf_dir, MEDIA))


@query("gps_positions", "F39 K6", """
select s_suppkey, case when s_suppkey % 2 = 0 then round(-(s_suppkey % 90 + (s_suppkey % 60) / 60.0 + 30 / 3600.0)::double, 6) else round((s_suppkey % 90 + (s_suppkey % 60) / 60.0 + 30 / 3600.0)::double, 6) end as lat from {supplier}""")
def gps_positions(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    dms = F.array((k % 90).cast("double"), (k % 60).cast("double"), F.lit(30.0))
    return s.select("s_suppkey", F.round(fm.dms_to_decimal(dms, F.when(k % 2 == 0, "S").otherwise("N")), 6).alias("lat"))


@query("gps_coverage", "A19", f"select category, count(*) as files, count(lat) as with_gps from (select {_CATEGORY} as category, case when id % 3 = 1 then v end as lat from ({MEDIA}) m) c group by 1")
def gps_coverage(spark, sf_dir):
    return om.gps_coverage(om.with_category(derive(spark, sf_dir, MEDIA)).withColumn("lat", F.when(F.col("id") % 3 == 1, F.col("v"))))


DETECTIONS = """
select doc_id as image_id, case (doc_id + quality) % 4 when 0 then 'BUTTOCKS_EXPOSED' when 1 then 'FACE' when 2 then 'ANUS_EXPOSED' else 'MALE_BREAST_EXPOSED' end as label, toxic * 0.3 + quality * 0.3 + 0.2 as score from {labels}
union all select doc_id, 'MALE_BREAST_EXPOSED', 0.5 from {labels} where doc_id % 2 = 0"""


@query("detection_severity", "P25", f"""
select image_id, case when bool_or(label = 'ANUS_EXPOSED') then 'HIGH' else 'MODERATE' end as severity, count(*) as detections from ({DETECTIONS}) d where label <> 'FACE' and score >= 0.5 group by image_id""")
def detection_severity(spark, sf_dir):
    return om.detection_severity(derive(spark, sf_dir, DETECTIONS), 0.5)


@query("detection_stats", "A23 L7", f"select label, count(*) as detections from ({DETECTIONS}) d where label <> 'FACE' and score >= 0.5 group by label")
def detection_stats(spark, sf_dir):
    return om.detection_stats(derive(spark, sf_dir, DETECTIONS), 0.5)


# -- files --------------------------------------------------------------------------------------

FILES = "select doc_id, 'root/' || source || case when doc_id % 4 = 0 then '/images' else '' end as folder, '.' || lang as kind from {documents}"


@query("directory_plan", "A26", f"""
select folder, count(*) as files, count(distinct kind) as types, count(*) >= 8 and count(distinct kind) >= 2 and not ends_with(folder, '/images') as split_by_type from ({FILES}) f group by folder""")
def directory_plan(spark, sf_dir):
    return om.directory_plan(derive(spark, sf_dir, FILES), "folder", "kind")


@query("drive_destinations", "A26 K7", f"""
with p as (select folder, count(*) >= 8 and count(distinct kind) >= 2 and not ends_with(folder, '/images') as s from ({FILES}) f group by folder)
select doc_id, case when s then folder || '/' || kind else folder end as dest_dir from ({FILES}) f join p using (folder)""")
def drive_destinations(spark, sf_dir):
    f = derive(spark, sf_dir, FILES)
    return om.drive_destinations(f, om.directory_plan(f, "folder", "kind"), "folder", "kind").select("doc_id", "dest_dir")


@query("flat_folders", "A26", f"""
with c as (select folder, count(*) as files from ({FILES}) f group by folder) select folder, files from c where files >= 5 and folder not in (select replace(folder, '/images', '') from c where ends_with(folder, '/images')) and folder <> 'root'""")
def flat_folders(spark, sf_dir):
    return om.flat_folder_plan(derive(spark, sf_dir, FILES), "folder")


STEMS = """
select p_partkey as id, p_brand as top, case p_partkey % 4 when 0 then p_name || ' v2' when 1 then 'draft_' || p_name || '_2021-03-04' when 2 then p_type || '-final' else 'scan' || cast(p_partkey % 400 as varchar(9)) || ' ' || p_name end
  || case when p_partkey % 97 = 0 then ' lighthouse' when p_partkey % 131 = 1 then ' harbour' when p_partkey % 211 = 5 then ' obelisk' else '' end as stem from {part}"""
_TOKENS = r"""list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(stem, '20\d{2}[-_.]?\d{2}[-_.]?\d{0,2}', '', 'g'), '(?i)\b(v\d+(\.\d+)?|rev\d+)\b', '', 'g'), '[^a-zA-Z0-9]+'), lambda x: lower(x)),
  lambda x: length(x) >= 4 and not list_contains(""" + sql_list(fr.IGNORED_TOKENS) + ", x))"


@query("project_tokens", "A27 F35", f"""
with t as (select id, top, list_tok[i] as token, i from (select *, {_TOKENS} as list_tok, unnest(range(1, len({_TOKENS}) + 1)) as i from ({STEMS.replace('{part}', 'part')}) s) u),
g as (select token, count(*) as uses from t group by token having count(*) between 3 and 40 and count(distinct top) >= 2 and length(token) >= 5 and regexp_full_match(token, '[a-z]+'))
select id, upper(substring(token, 1, 1)) || substring(token, 2) as project, uses from (select t.id, t.token, uses, row_number() over (partition by id order by uses desc, i) as k from t join g using (token)) r where k = 1""")
def project_tokens(spark, sf_dir):
    return om.project_tokens(derive(spark, sf_dir, STEMS), "id", F.col("stem"), F.col("top"), 3, 40)


NAMED = "select p_partkey as id, p_brand as folder, p_name || case when p_partkey % 3 = 0 then '' else '.jpg' end as name from {part}"


@query("collision_names", "W11", f"""
select id, folder, case when n = 1 then name when id % 3 = 0 then name || '_' || (n - 1) else replace(name, '.jpg', '') || '_' || (n - 1) || '.jpg' end as dest_name
from (select *, row_number() over (partition by folder, name order by id) as n from ({NAMED}) f) r""")
def collision_names(spark, sf_dir):
    f = derive(spark, sf_dir, NAMED)
    return oo.unique_destinations(f, "folder", "name", [F.asc("id")], oo.slice_of(f, "id")).select("id", "folder", "dest_name")


PATHS = """
select doc_id, '/drive/' || case doc_id % 6 when 0 then 'Documents/2024' when 1 then 'Downloads/' || source || ' & co' when 2 then '3f2a9c1e-0000-4000-8000-123456789abc/Big ' || lang when 3 then 'ab' when 4 then '2023-05/Proj ' || lang || '/sub/deep' else 'archive' end
  || '/' || case doc_id % 3 when 0 then 'IMG_20230405_x' when 1 then '2022-13-01 2021.06 note' else 'plain' end || '.jpg' as path from {documents}"""


@query("file_dates", "F34 F54 P28", f"""
select doc_id, case doc_id % 3 when 0 then '2023-04-05' when 1 then '2021-06-01' else '2020-01-02' end as day, '2020-01-02_' || name as prefixed, name as restored, false as had_prefix
from (select doc_id, split_part(path, '/', -1) as name from ({PATHS}) p) n""")
def file_dates(spark, sf_dir):
    p = derive(spark, sf_dir, PATHS).withColumn("name", fm.file_name(F.col("path")))
    mod = F.lit("2020-01-02").cast("date")
    plain_name = F.when(fd.has_date_prefix(F.col("name")), F.concat(F.lit("x"), "name")).otherwise(F.col("name"))
    p = p.withColumn("p", fd.add_date_prefix(plain_name, mod))
    return p.select("doc_id", fd.file_date(sc.stem_of(F.col("name")), mod).alias("day"), F.col("p").alias("prefixed"),
                    fd.drop_date_prefix(F.col("p")).alias("restored"), fd.has_date_prefix(F.col("name")).alias("had_prefix"))


@query("folder_contexts", "F36 F37", f"""
select doc_id, case doc_id % 6 when 0 then '2024' when 1 then source || ' & co' when 2 then '3f2a9c1e-0000-4000-8000-123456789abc|Big ' || lang when 3 then 'ab' when 4 then '2023-05|Proj ' || lang || '|sub|deep' else '' end as context,
  case doc_id % 6 when 1 then source || '  co' when 2 then 'Big ' || lang when 4 then 'Proj ' || lang else '' end as project,
  case doc_id % 6 when 4 then 'sub/deep' else '' end as below from {{documents}}""")
def folder_contexts(spark, sf_dir):
    p = derive(spark, sf_dir, "select d.doc_id, d.source, d.lang, p.path from {documents} d join (" + PATHS + ") p on p.doc_id = d.doc_id")
    ctx = fm.folder_context(F.col("path"), "/drive")
    named = p.withColumn("project", fm.folder_project(ctx)).withColumn("ctx", ctx)
    below = F.when(F.col("project") != "", fm.sub_path(F.col("path"), F.when(F.contains("project", F.lit("co")), F.concat("source", F.lit(" & co"))).otherwise(F.col("project")), "/drive")).otherwise("")
    return named.select("doc_id", F.col("ctx").alias("context"), "project", below.alias("below"))


@query("file_types", "P24", f"""
select id, case lower(ext) when '.png' then 'Image' when '.heic' then 'Image' when '.jpg' then 'Image' when '.mov' then 'Video' when '.gif' then 'Image' when '.txt' then 'Text' when '.jpeg' then 'Image' else 'Other' end as document_type,
  case lower(ext) when '.png' then 'Images' when '.heic' then 'Images' when '.jpg' then 'Images' when '.mov' then 'Video' when '.gif' then 'Images' when '.txt' then 'Documents' when '.jpeg' then 'Images' else 'Other' end as drive_type from ({MEDIA}) m""")
def file_types(spark, sf_dir):
    return derive(spark, sf_dir, MEDIA).select("id", fm.file_type(F.col("ext")).alias("document_type"), fm.file_type(F.col("ext"), fr.DRIVE_TYPES).alias("drive_type"))


# The cascade over every document: known names in folders and texts, tokens, categories, types.
PLACED = """
select '/drive/' || case doc_id % 5 when 0 then 'Harbour Works/contracts' when 1 then 'docs' when 2 then 'Ann Lee' when 3 then 'misc/old' else 'Studio ' || source end || '/' ||
  case when doc_id % 37 = 0 then 'lighthouse plan' else 'note' end || cast(doc_id as varchar(20)) || case when doc_id % 7 = 0 then '.jpg' else '.txt' end as path, text, timestamp '2020-03-04 00:00:00' as mod_time, doc_id from {documents}"""
KNOWN = [("harbour works", "Harbour Works")]
PEOPLE = [("ann lee", "Ann Lee")]
COMPANIES = [("released under the mit", "MIT")]


@query("document_placement", "F38 R9 J6 F21", f"""
with p as (select *, split_part(path, '/', -1) as name, ends_with(path, '.jpg') as media, lower(text) as low from ({PLACED}) f),
tok as (select count(*) as n, count(distinct split_part(path, '/', 3)) as tops from p where contains(name, 'lighthouse')),
c as (select p.*, (select n from tok) as tn, (select tops from tok) as tt, {{scores}} as sc from p)
select path, case when doc_id % 5 = 0 then 'Projects/Harbour_Works/contracts'
  when contains(name, 'lighthouse') and tn between 3 and 12 and tt >= 2 then 'Projects/Lighthouse'
  when doc_id % 5 = 2 then 'People/Ann_Lee' when doc_id % 5 = 4 then 'Projects/Studio_' || split_part(split_part(path, '/', 3), ' ', 2)
  when media then 'Image/2020-03' when contains(low, 'harbour works') then 'Projects/Harbour_Works' when contains(low, 'ann lee') then 'People/Ann_Lee' when contains(low, 'released under the mit') then 'Companies/MIT'
  when list_max(sc) >= 2.0 then ({sql_list(list(fr.DOCUMENT_CATEGORIES))})[list_position(sc, list_max(sc))] || '/2020-03' else 'Text/2020-03' end as dest_dir from c""".replace(
    "{scores}", "[" + ", ".join(f"(select count(*) from (select unnest({sql_list(w)}) as k) x where contains(replace(name, '.txt', '') || ' ' || low, k)) * {g}::double" for g, w in fr.DOCUMENT_CATEGORIES.values()) + "]"))
def document_placement(spark, sf_dir):
    d = lambda rows: spark.createDataFrame(rows, "key string, display string")
    placed = om.place(derive(spark, sf_dir, PLACED), d(KNOWN), d(PEOPLE), d(COMPANIES), "/drive")
    return placed.select("path", "dest_dir")


# -- picking ------------------------------------------------------------------------------------

PICKS = """
select p_partkey as id, p_brand as work, case p_partkey % 5 when 0 then 'Photos' when 1 then 'Press/invoice' when 2 then '_meta' else '' end as folder,
  case p_partkey % 9 when 0 then 'IMG_' || cast(p_partkey as varchar(9)) when 1 then p_name || ' front' when 2 then cast(p_partkey as varchar(9)) when 3 then p_brand when 4 then 'Screen Shot ' || p_type when 5 then p_name || '__2' when 6 then '_series' else p_name || ' back thumbnail' end
  || case p_partkey % 4 when 0 then '.jpg' when 1 then '.PNG' when 2 then '.tif' else '.txt' end as name, p_size * 200000 as size from {part}"""
_PICKED = r"""
select id, work, 0 + case when tk <> '' and contains(sq, tk) then 5 when len(toks) > 0 and m / len(toks)::double >= 0.5 then 3 when m >= 2 then 2 else 0 end
  + case when contains(bl, 'front') then 3 else 0 end + case when regexp_full_match(bl, '[a-z][a-z0-9\-_\s]*[a-z0-9]') and not starts_with(bl, 'img') then 2 else 0 end
  + case when ext in ('.jpg', '.jpeg', '.png') then 2 else 0 end + case when ext in ('.tif') then -1 else 0 end + case when length(base) > 12 then 2 when length(base) <= 6 then -1 else 0 end
  + least(size // 1048576, 4) + case when regexp_matches(bl, '^(img[_ ]|os6a|dsc|p\d{7})') then -3 else 0 end + case when regexp_matches(bl, '^(screen shot|screenshot)') then -5 else 0 end
  + case when contains(lower(name), 'back') then -2 else 0 end + case when regexp_matches(base, '__\d+$') then -1 else 0 end + case when contains(lower(name), 'thumbnail') then -2 else 0 end + case when regexp_full_match(base, '\d+') then -5 else 0 end
  + case folder when 'Photos' then 4 when 'Press/invoice' then -11 else 0 end as score
from (select *, len(list_filter(toks, lambda t: contains(sq, regexp_replace(t, '[^a-z0-9]+', '', 'g')))) as m from (
  select *, lower(base) as bl, regexp_replace(lower(base), '[^a-z0-9]+', '', 'g') as sq, regexp_replace(lower(work), '[^a-z0-9]+', '', 'g') as tk, list_filter(regexp_split_to_array(lower(work), '[\s\-_]+'), lambda t: length(t) >= 3) as toks
  from (select *, regexp_replace(name, '\.[^.]*$', '') as base, lower(regexp_extract(name, '(\.[^.]*)$', 1)) as ext from (""" + PICKS + r""") p) a
  where ext <> '.txt' and folder <> '_meta' and not starts_with(name, '_series')) b) c"""


@query("hero_scores", "P27 F31 F32", f"select id, work, cast(score as bigint) as score from ({_PICKED}) h")
def hero_scores(spark, sf_dir):
    return om.hero_candidates(derive(spark, sf_dir, PICKS)).select("id", "work", "score")


@query("hero_ranking", "W12", f"select id, work, row_number() over (partition by work order by score desc, id) as rank from ({_PICKED}) h")
def hero_ranking(spark, sf_dir):
    return oo.rank_candidates(om.hero_candidates(derive(spark, sf_dir, PICKS)), "work", "score", "id").select("id", "work", "rank")


CHOICES = "select case when o_custkey % 10 = 0 then 'x' else 'w' end || cast(o_custkey as varchar(20)) as work_id, case when o_custkey % 7 = 0 then '__SKIP__' else 'f' || cast(o_custkey % 5 as varchar(5)) end as choice from {orders} group by o_custkey"
WORKS = "select 'w' || cast(c_custkey as varchar(20)) as work_id from {customer}"
HAVE = "select 'w' || cast(c_custkey as varchar(20)) as work_id, 'f' || cast(c_nationkey % 5 as varchar(5)) as filename from {customer}"
_STATUS = f"""
select coalesce(s.work_id, w.work_id) as work_id, choice, case when choice = '__SKIP__' then 'skipped' when s.work_id is null then 'pending' when w.work_id is null then 'unknown_work' when h.work_id is null then 'missing_file' else 'picked' end as status
from ({CHOICES}) s full join ({WORKS}) w on s.work_id = w.work_id left join (select distinct * from ({HAVE}) h) h on h.work_id = s.work_id and h.filename = choice"""


def _status(spark, sf_dir):
    return om.apply_selections(derive(spark, sf_dir, CHOICES), derive(spark, sf_dir, WORKS), derive(spark, sf_dir, HAVE))


@query("selection_status", "J9", _STATUS)
def selection_status(spark, sf_dir):
    return _status(spark, sf_dir)


@query("selection_stats", "A31", f"select status, count(*) as works from ({_STATUS}) s group by status")
def selection_stats(spark, sf_dir):
    return om.selection_stats(_status(spark, sf_dir))


# -- press --------------------------------------------------------------------------------------

@query("article_status", "P17", """
select page_id, case when page_id % 7 = 0 then 'skipped' when page_id % 2 = 0 then 'done' when page_id % 3 = 0 then 'partial' else 'dead-link' end as status from {pages}""")
def article_status(spark, sf_dir):
    k = F.col("page_id")
    p = table(spark, sf_dir, "pages").select("page_id", (k % 7 == 0).alias("is_video"), (k % 3 == 0).alias("has_screenshot"), (k % 2 == 0).alias("has_html"))
    return op.processing_status(p).select("page_id", "status")


@query("article_gates", "P14 P15", r"""
select page_id from (select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as t, length(html) as n from pages) p where n >= 2000 and not regexp_matches(lower(t), '404|not found|error')""")
def article_gates(spark, sf_dir):
    p = table(spark, sf_dir, "pages").withColumn("title", F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    return op.kept_articles(p, "html", 2000).select("page_id")


LOG = "select case o_orderkey % 4 when 0 then 'partial' when 1 then 'dead-link' when 2 then 'done' else 'skipped' end as status, year(o_orderdate) as year, 'out' || cast(o_custkey % 40 as varchar(5)) as outlet, 'h' || cast(o_orderkey as varchar(20)) as headline from {orders} where o_orderstatus <> 'P'"
UPDATES = "select 'done' as status, year(o_orderdate) as year, 'out' || cast(o_custkey % 40 as varchar(5)) || '-2' as outlet, 'new' || cast(o_orderkey as varchar(20)) as headline from {orders} where o_orderstatus = 'P' and o_custkey % 3 = 0"


@query("log_upsert", "K9", f"""
with u as (select * from (select *, row_number() over (partition by year, outlet order by headline) as k from ({UPDATES}) u) r where k = 1)
select status, year, outlet, headline from ({LOG}) l where status not in ('partial', 'dead-link') or not exists (select 1 from u where u.year = l.year and regexp_replace(u.outlet, '-[2-6]$', '') = l.outlet)
union all select status, year, outlet, headline from u""")
def log_upsert(spark, sf_dir):
    return op.upsert_log(derive(spark, sf_dir, LOG), derive(spark, sf_dir, UPDATES))


IMAGES = "select page_id, url, case page_id % 6 when 0 then '//cdn.example/p.jpg' when 1 then '/img/a.png' when 2 then 'https://web.archive.org/web/2020id_/http://x.example/y.jpg' when 3 then 'data:image/png;base64,xx' when 4 then 'https://x.example/banner.png' else 'rel/q.jpg' end as src, case when page_id % 5 = 0 then '10px' else '400' end as w, '300' as h from {pages}"


@query("image_addresses", "F50 F51", f"""
select page_id, case when starts_with(src, 'https://web.archive.org') then 'http://x.example/y.jpg' when regexp_matches(src, '^(https?://|data:)') then src when starts_with(src, '//') then 'https:' || src when starts_with(src, '/') then regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) || src else src end as address,
  exists (select 1 from (select unnest({sql_list(fr.AD_IMAGE_PARTS)}) as k) x where contains(lower(src), k)) or w = '10px' or starts_with(src, 'data:') as dropped from ({IMAGES}) i""")
def image_addresses(spark, sf_dir):
    i = derive(spark, sf_dir, IMAGES)
    return i.select("page_id", ft.absolute_url(F.col("src"), F.col("url")).alias("address"), ft.is_ad_image(F.col("src"), F.col("w"), F.col("h")).alias("dropped"))


# -- notes --------------------------------------------------------------------------------------

# Pages stand for notes: a page links to the words in its navigation; parts of its path give type and status.
NOTES = r"""
select case page_id % 5 when 0 then '04_CANON/' when 1 then '05_PROJECTS/Active/' when 2 then '05_PROJECTS/Archived/' when 3 then '06_OUTPUTS/' else '08_RESEARCH/' end || word || '.md' as path, word as title,
  case page_id % 5 when 0 then 'canon' when 1 then 'project' when 2 then 'project' when 3 then 'output' else '' end as type, case page_id % 3 when 0 then 'active' when 1 then 'archived' else '' end as status, day as last_updated, body
from (select page_id, 'N' || cast(page_id % 91 as varchar(9)) as word, date_add(date '2024-01-01', cast(page_id % 200 as int)) as day,
  'See [[N' || cast(page_id * 14 % 120 as varchar(9)) || ']] and [[N' || cast(page_id * 6 % 100 as varchar(9)) || '|alias]]' || case when page_id % 4 = 0 then ' or [[04_CANON/N' || cast(page_id % 60 as varchar(9)) || '.md]] [[idea]]' else '' end || case when page_id % 6 = 0 then '' else '
a
b
c
d' end as body from {pages}) p"""
NOTES_DUCK = NOTES.replace("date_add(date '2024-01-01', cast(page_id % 200 as int))", "date '2024-01-01' + cast(page_id % 200 as int)")
_LINKS = f"select distinct path as src, split_part(raw, '|', 1) as target from (select path, unnest(regexp_extract_all(body, '\\[\\[([^\\]]+)\\]\\]', 1)) as raw from ({NOTES_DUCK}) n) r where split_part(raw, '|', 1) <> ''"


def _notes(spark, sf_dir):
    n = derive(spark, sf_dir, NOTES)
    return n, lint.note_links(n)


@query("note_links", "J16", _LINKS)
def note_links(spark, sf_dir):
    return _notes(spark, sf_dir)[1]


@query("broken_links", "Q1 J16", f"""
with n as ({NOTES_DUCK}), l as ({_LINKS}) select 'broken_link' as check, src as path, target as detail from l where target not in ({", ".join(sql_text(a) for a in fr.ALLOWED_DANGLING)})
  and not (not contains(target, '/') and target in (select title from n)) and not (contains(target, '/') and regexp_replace(target, '\\.md$', '') in (select regexp_replace(path, '\\.md$', '') from n))""".replace(" as check", ' as "check"'))
def broken_links(spark, sf_dir):
    n, links = _notes(spark, sf_dir)
    return lint.broken_links(links, n)


def _lint_query(name, covers, sql, fn):
    @query(name, covers, sql.replace(" as check", ' as "check"'))
    def run(spark, sf_dir):
        return fn(*_notes(spark, sf_dir))
    return run


_LINES = "len(list_filter(string_split(body, chr(10)), lambda x: trim(x) <> ''))"
_lint_query("stub_notes", "Q2", f"select 'stub' as check, path, cast({_LINES} as varchar) as detail from ({NOTES_DUCK}) n where {_LINES} < 5", lambda n, links: lint.stubs(n))
_lint_query("duplicate_notes", "Q3", f"select 'duplicate_name' as check, title as path, cast(count(distinct regexp_replace(path, '/[^/]*$', '')) as varchar) as detail from ({NOTES_DUCK}) n group by title having count(distinct regexp_replace(path, '/[^/]*$', '')) > 1",
            lambda n, links: lint.duplicates(n))
_lint_query("orphan_notes", "Q4", f"select 'orphan' as check, path, type as detail from ({NOTES_DUCK}) n where type in ('canon', 'project', 'output') and title not in (select regexp_replace(split_part(target, '/', -1), '\\.md$', '') from ({_LINKS}) l)",
            lambda n, links: lint.orphans(n, links))
_lint_query("missing_frontmatter", "Q5", f"select 'missing_frontmatter' as check, path, concat_ws(',', case when type = '' then 'type' end, case when status = '' then 'status' end) as detail from ({NOTES_DUCK}) n where type = '' or status = ''",
            lambda n, links: lint.missing_frontmatter(n))
_lint_query("status_mismatch", "Q6", f"select 'status_mismatch' as check, path, status || ' in ' || split_part(path, '/', 2) as detail from ({NOTES_DUCK}) n where type = 'project' and lower(split_part(path, '/', 2)) <> status",
            lambda n, links: lint.status_mismatch(n))
_lint_query("naming_violations", "Q7", f"select 'naming' as check, path, type as detail from ({NOTES_DUCK}) n where (type = 'canon' and not regexp_matches(title, '^N[0-4]')) or (type = 'output' and not regexp_matches(title, '[02468]$'))",
            lambda n, links: lint.naming(n, {"canon": "^N[0-4]", "output": "[02468]$"}))
_lint_query("concepts_without_page", "Q8", f"select 'concept_without_page' as check, target as path, cast(count(distinct src) as varchar) as detail from ({_LINKS}) l where target not in (select title from ({NOTES_DUCK}) n) group by target having count(distinct src) >= 3",
            lambda n, links: lint.concepts(links, n))
_lint_query("stale_notes", "Q9", f"select 'stale' as check, path, cast(date_diff('day', last_updated, date '2024-07-01') as varchar) as detail from ({NOTES_DUCK}) n where date_diff('day', last_updated, date '2024-07-01') > 90",
            lambda n, links: lint.stale(n, "2024-07-01"))
_lint_query("underlinked_notes", "Q10 X3", f"with o as (select src, count(*) as n from ({_LINKS}) l group by src) select 'underlinked' as check, path, cast(coalesce(o.n, 0) as varchar) as detail from ({NOTES_DUCK}) t left join o on o.src = path where type = 'canon' and coalesce(o.n, 0) < 3",
            lambda n, links: lint.underlinked(n, links, 3))
_lint_query("folders_not_empty", "Q11", f"select 'not_empty' as check, split_part(path, '/', 1) as path, cast(count(*) as varchar) as detail from ({NOTES_DUCK}) n where split_part(path, '/', 1) in ('04_CANON', '05_PROJECTS', '06_OUTPUTS') group by 2",
            lambda n, links: lint.not_empty(n.select("path")))

_LEAKS = [*fr.PRIVATE_PATTERNS, (r"MIT License", "License"), (r"[0-9]{3}-[0-9]{4}", "Phone")]
_LEAK = " union all ".join(
    f"select {sql_text(c)} as category, {sql_text(p)} as pattern, doc_id as path, i as line_no, ls[i] as line from (select doc_id, string_split(text, chr(10)) as ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from documents) d where regexp_matches(ls[i], {sql_text(p)})"
    for p, c in _LEAKS)


@query("leak_report", "Q12 J15 X1", _LEAK)
def leak_report(spark, sf_dir):
    return lint.leak_report(table(spark, sf_dir, "documents"), _LEAKS, "doc_id", "text")


@query("leak_counts", "J15", f"select category, pattern, count(*) as lines from ({_LEAK}) l group by 1, 2")
def leak_counts(spark, sf_dir):
    return lint.scan_patterns(table(spark, sf_dir, "documents"), _LEAKS, "doc_id", "text")


CLAIMS = "select o_custkey as entity, o_orderstatus as attribute, 'v' || cast(o_orderkey % 4 as varchar(5)) as value, cast(substring(o_orderpriority, 1, 1) as int) as level, o_orderkey as source from {orders}"


@query("source_authority", "Q13", f"""
with v as (select entity, attribute, value, min((level, source)) as k from ({CLAIMS}) c group by 1, 2, 3)
select entity, attribute, value, cast(k[1] as bigint) as level, n_conflicts from (select *, count(*) over (partition by entity, attribute) - 1 as n_conflicts, row_number() over (partition by entity, attribute order by k) as r from v) w where r = 1""")
def source_authority(spark, sf_dir):
    return lint.by_authority(derive(spark, sf_dir, CLAIMS))


CITATIONS = "select o_custkey as page, case o_orderkey % 7 when 0 then 'primary' when 1 then 'institutional' when 2 then 'secondary' when 3 then 'opinion' else 'aggregator' end as tag from {orders}"


@query("page_confidence", "Q14", f"""
select page, citations, strong, weak, case when strong >= 2 and strong * 2 > citations then 'high' when strong >= 1 or weak * 2 < citations then 'medium' else 'low' end as confidence
from (select page, count(*) as citations, count(*) filter (where tag in ('primary', 'institutional')) as strong, count(*) filter (where tag in ('opinion', 'aggregator')) as weak from ({CITATIONS}) c group by page) p""")
def page_confidence(spark, sf_dir):
    return lint.confidence(derive(spark, sf_dir, CITATIONS))


@query("priority_drift", "Q15", """
select c_custkey as project from {customer} where c_mktsegment = 'MACHINERY' and not exists (select 1 from {orders} where o_custkey = c_custkey and date_diff('day', cast(o_orderdate as date), date '2001-08-02') between 0 and 90)""")
def priority_drift(spark, sf_dir):
    p = derive(spark, sf_dir, "select c_custkey as project, case when c_mktsegment = 'MACHINERY' then 'active' else 'parked' end as status from {customer}")
    a = derive(spark, sf_dir, "select o_custkey as project, o_orderdate as ts from {orders}")
    return lint.drift(p, a, "2001-08-02").select("project")


# -- ideas and rendering ------------------------------------------------------------------------

IDEAS = "select l_orderkey, l_linenumber, l_partkey % 5 + 1 as heat, l_suppkey % 5 + 1 as edge, l_orderkey % 5 + 1 as legend, l_linenumber % 5 + 1 as ship, cast(l_quantity as int) % 5 + 1 as yield_, cast(l_quantity as int) % 4 + 1 as drag from {lineitem}"


@query("idea_scores", "F33 P26", f"""
select l_orderkey, l_linenumber, heat, score, case when score >= 22 then 'Now' when score >= 17 then 'Queue' when score >= 12 then 'Incubate' when score >= 7 then 'Back burner' else 'Reframe' end as stage
from (select *, cast(heat + 2 * edge + legend + ship + yield_ - drag as bigint) as score from ({IDEAS}) i) s""".replace("l_linenumber, heat, score", "cast(l_linenumber as bigint) as l_linenumber, heat, score"))
def idea_scores(spark, sf_dir):
    i = derive(spark, sf_dir, IDEAS)
    s = sc.idea_score(*[F.col(c) for c in ("heat", "edge", "legend", "ship", "yield_", "drag")])
    return i.withColumn("score", s).select("l_orderkey", "l_linenumber", "heat", "score", sc.idea_stage(F.col("score")).alias("stage"))


@query("rendered_pages", "K5", """
select conv_id, (n - 1) // 3 as part, count(*) as lines, string_agg('**' || role || '**: ' || text, chr(10) order by turn) as page
from (select *, row_number() over (partition by conv_id order by turn) as n from {conversations}) c group by 1, 2""")
def rendered_pages(spark, sf_dir):
    line = F.concat(F.lit("**"), "role", F.lit("**: "), "text")
    return reports.render_pages(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], line, F.shiftright("turn", 8), 3)


@query("work_batches", "L6", "select doc_id, source from {documents} order by doc_id limit 50 offset 100")
def work_batches(spark, sf_dir):
    return oo.batch(table(spark, sf_dir, "documents").select("doc_id", "source"), [F.asc("doc_id")], 100, 50)


@query("carried_values", "W13", """
select l_orderkey, l_linenumber, last_value(case when l_returnflag = 'R' then l_partkey end ignore nulls) over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey rows between unbounded preceding and current row) as carried from {lineitem}""".replace(
    "select l_orderkey, l_linenumber,", "select l_orderkey, cast(l_linenumber as bigint) as l_linenumber,"))
def carried_values(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("carried", F.when(F.col("l_returnflag") == "R", F.col("l_partkey")))
    order = [F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")]
    return oo.carry_forward(li, "carried", order, ["l_suppkey"], F.shiftright("l_orderkey", 12)).select("l_orderkey", "l_linenumber", "carried")
