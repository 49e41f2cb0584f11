"""Round trips: given tables written by a sink to the shared folder and read back by the reader."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthbook.catalogue.base import derive, query, table
from hearthbook.operators import chat as oc, lint, ordering as oo
from hearthbook.session import scratch_path
from hearthbook.sinks import writers as wr
from hearthbook.sources import archive as ar, mail

_ADDRESS = "c_name || '@mail.example'"


@query("contact_list_file", "S2 K2", "select lower(c_name || '@mail.example') as email from customer")
def contact_list_file(spark, sf_dir):
    path = scratch_path(spark, "contacts")
    wr.write_csv(derive(spark, sf_dir, "select ' ' || upper(c_name) || '@Mail.Example ' as email from {customer}"), path)
    return mail.read_contacts(spark, path)


@query("card_file", "S3", "select lower(c_name || '@mail.example') as email from customer where c_custkey % 3 > 0")
def card_file(spark, sf_dir):
    path = scratch_path(spark, "cards")
    derive(spark, sf_dir, """
        select 'BEGIN:VCARD' || chr(10) || case when c_custkey % 3 = 0 then 'NOTE:x@y.example' else 'EMAIL;TYPE=home: ' || c_name || '@mail.example' end
          || chr(10) || 'END:VCARD' as value from {customer}""").write.text(path)
    return mail.read_vcf_emails(spark, path)


@query("address_book_file", "S4", """
select lower(c_name) || '@' || k || '.example' as email, 'Given ' || c_custkey as gc_name, nullif(c_mktsegment, 'BUILDING') as gc_org, c_custkey::varchar as gc_phone
from customer, (select unnest(['home', 'work']) as k) e where k = 'home' or c_custkey % 2 = 0""")
def address_book_file(spark, sf_dir):
    path = scratch_path(spark, "book")
    derive(spark, sf_dir, """
        select 'Given' as `First Name`, cast(c_custkey as string) as `Last Name`, case when c_mktsegment = 'BUILDING' then '' else c_mktsegment end as `Organization Name`,
          cast(c_custkey as string) as `Phone 1 - Value`, c_name || '@home.example' as `E-mail 1 - Value`,
          case when c_custkey % 2 = 0 then c_name || '@work.example' end as `E-mail 2 - Value`, '' as `E-mail 3 - Value` from {customer}"""
           ).write.option("header", True).csv(path)
    return mail.read_address_book(spark, path).select("email", "gc_name", "gc_org", "gc_phone")


@query("crm_file", "S5", """
select lower(c_name || '@mail.example') as email, c_mktsegment as crm_name, case when c_custkey % 2 = 0 then c_custkey::varchar end as crm_phone from customer""")
def crm_file(spark, sf_dir):
    path = scratch_path(spark, "crm")
    derive(spark, sf_dir, f"""select {_ADDRESS} as Email, c_mktsegment as `Collector Name`, case when c_custkey % 2 = 0 then cast(c_custkey as string) else ' ' end as Phone
        from {{customer}}""").write.option("header", True).csv(path)
    return mail.read_crm(spark, path).select("email", "crm_name", "crm_phone")


@query("crm_last_row_wins", "S5", """
select 'segment-' || c_mktsegment || '@mail.example' as email, cast(max(c_custkey) as varchar) as crm_phone from customer group by c_mktsegment""".replace(
    "'segment-' || c_mktsegment", "lower('segment-' || c_mktsegment)"))
def crm_last_row_wins(spark, sf_dir):
    path = scratch_path(spark, "crm")
    rows = derive(spark, sf_dir, "select c_custkey, 'segment-' || c_mktsegment || '@mail.example' as Email, cast(c_custkey as string) as Phone from {customer}")
    rows.repartitionByRange(4, "c_custkey").sortWithinPartitions("c_custkey").drop("c_custkey").write.option("header", True).csv(path)
    return mail.read_crm(spark, path).select("email", "crm_phone")


_BUNDLES = "select c_name || '@mail.example' as email, c_custkey as total_emails, c_mktsegment as source_account, array(c_name, c_mktsegment) as display_names from {customer}"


@query("bundle_files", "S7 K1 U3", """
select c_name || '@mail.example' as email, cast(c_custkey as bigint) as total_emails, c_mktsegment as source_account, c_name || '|' || c_mktsegment as display_names from customer
union all select s_name || '@mail.example', cast(s_suppkey as bigint), 'suppliers', null from supplier""")
def bundle_files(spark, sf_dir):
    one, two = scratch_path(spark, "bundles"), scratch_path(spark, "bundles")
    wr.write_bundles(derive(spark, sf_dir, _BUNDLES), one, buckets=8)
    wr.write_bundles(derive(spark, sf_dir, "select s_name || '@mail.example' as email, s_suppkey as total_emails, 'suppliers' as source_account from {supplier}"), two, buckets=2)
    both = mail.read_many([mail.read_bundles(spark, p, multi_line=False) for p in (one, two)])
    return both.select("email", "total_emails", "source_account", "display_names")


@query("enrichment_files", "S8", """
select lower(c_name || '@mail.example') as email, c_mktsegment as role_title from customer""")
def enrichment_files(spark, sf_dir):
    path = scratch_path(spark, "results")
    # one list per file of a hundred customers: shaped like the answers of a batch
    rows = derive(spark, sf_dir, "select cast(c_custkey / 100 as bigint) as part, upper(c_name) || '@mail.example' as email, c_mktsegment as role_title from {customer}")
    lists = rows.groupBy("part").agg(F.to_json(F.collect_list(F.struct("email", "role_title"))).alias("value"))
    parts = lists.count()
    lists.repartitionByRange(parts, "part").select("value").write.text(path)
    return mail.read_enrichments(spark, path).select("email", "role_title")


@query("graph_document", "K3", """
select 'node' as part, n_nationkey::varchar as a, n_name as b from nation union all select 'edge', s_suppkey::varchar, s_nationkey::varchar from supplier
union all select 'stats', count(*)::varchar, 'nodes' from nation""")
def graph_document(spark, sf_dir):
    path = scratch_path(spark, "graph")
    nodes = derive(spark, sf_dir, "select cast(n_nationkey as string) as a, n_name as b from {nation}")
    edges = derive(spark, sf_dir, "select cast(s_suppkey as string) as a, cast(s_nationkey as string) as b from {supplier}")
    wr.write_graph(nodes, edges, nodes.agg(F.count("*").cast("string").alias("a"), F.lit("nodes").alias("b")), path)
    back = [spark.read.schema("a string, b string").json(f"{path}/{d}").select(F.lit(p).alias("part"), "a", "b")
            for p, d in (("node", "nodes"), ("edge", "edges"), ("stats", "stats"))]
    return mail.read_many(back)


@query("domain_files", "K4", "select c_mktsegment as domain, count(*) as n, cast(sum(c_custkey) as bigint) as keys from customer group by 1")
def domain_files(spark, sf_dir):
    path = scratch_path(spark, "domains")
    wr.write_domains(derive(spark, sf_dir, "select c_custkey, c_mktsegment as domain from {customer}"), path)
    return spark.read.json(path).groupBy("domain").agg(F.count("*").alias("n"), F.sum("c_custkey").alias("keys"))


@query("page_files", "K5", """
select conv_id::varchar as page, line from (select conv_id, unnest(string_split(role || ': ' || text, chr(10))) as line from conversations) c""")
def page_files(spark, sf_dir):
    path = scratch_path(spark, "pages")
    lines = derive(spark, sf_dir, "select conv_id, turn, role || ': ' || text as line from {conversations}")
    wr.write_pages(lines, path, "conv_id", ["turn"])
    back = spark.read.option("lineSep", "\n").text(path)
    return back.select(F.col("page").cast("string").alias("page"), F.col("value").alias("line"))


@query("location_file", "K6", """
select s_name as filename, round(s_suppkey / 7.0::double, 6) as latitude, round(-s_suppkey / 11.0::double, 6) as longitude from supplier where s_suppkey % 4 > 0""")
def location_file(spark, sf_dir):
    path = scratch_path(spark, "places")
    rows = derive(spark, sf_dir, """
        select s_name as filename, 'Photos' as category, '2024-01' as month, case when s_suppkey % 4 > 0 then s_suppkey / 7.0D end as lat, -s_suppkey / 11.0D as lon,
          12.34D as alt, timestamp '2024-01-02 03:04:05' as taken_at, 'p' as path from {supplier}""")
    wr.write_locations(rows, path)
    return spark.read.option("header", True).csv(path).select(
        "filename", F.col("latitude").cast("double").alias("latitude"), F.col("longitude").cast("double").alias("longitude"))


@query("manifest_file", "K7", "select 'in/' || p_partkey as source, 'out/' || p_brand || '/' || p_partkey as destination from part")
def manifest_file(spark, sf_dir):
    path = scratch_path(spark, "manifest")
    wr.write_manifest(derive(spark, sf_dir, "select 'in/' || p_partkey as source, 'out/' || p_brand || '/' || p_partkey as destination, p_size from {part}"), path)
    return spark.read.option("header", True).csv(path)


@query("contact_sheet_file", "K8", """
select row_number() over (order by c_acctbal desc, c_custkey) as rank, c_name as name, 'Tier 1' as tier from customer""")
def contact_sheet_file(spark, sf_dir):
    path = scratch_path(spark, "sheet")
    rows = derive(spark, sf_dir, """
        select row_number() over (order by c_acctbal desc, c_custkey) as rank, c_name as name, 1 as tier, c_custkey as score, 2 as messages, array('a', 'b') as tags, 's' as snippet
        from {customer}""")
    wr.write_contact_sheet(rows, path)
    return spark.read.option("header", True).csv(path).select(F.col("Rank").cast("bigint").alias("rank"), F.col("Name").alias("name"), F.col("Tier").alias("tier"))


@query("rule_file", "S18 K10", """
select category, count(*) as lines from (select unnest(string_split(text, chr(10))) as line from documents) d
join (values ('Licence', 'License'), ('Bar', 'zz|top$')) r(category, pattern) on regexp_matches(line, pattern) group by 1""")
def rule_file(spark, sf_dir):
    path = scratch_path(spark, "rules")
    derive(spark, sf_dir, "select case r_regionkey when 0 then '# rules' when 1 then '' when 2 then 'no bar here' when 3 then 'License|Licence' else 'zz|top$|Bar' end as value from {region}"
           ).write.text(path)
    rules = [(r.pattern, r.category) for r in ar.read_rules(spark, path).collect()]  # a rule file is small
    hits = lint.scan_patterns(table(spark, sf_dir, "documents"), rules, "doc_id", "text")
    report = scratch_path(spark, "report")
    wr.write_report(hits, report)
    return spark.read.schema("category string, pattern string, lines bigint").json(report).select("category", "lines")


_ORDER = """select event_id, row_number() over (order by ts nulls first, event_id) as place from (
  select event_id, case when event_id % 50 = 0 then null else ts end as ts from {events}) e"""


@query("chronological_order", "L3", _ORDER.replace("{events}", "events"))
def chronological_order(spark, sf_dir):
    """The order of the sorted rows, read off the sorted table's own partitions."""
    rows = derive(spark, sf_dir, "select event_id, case when event_id % 50 = 0 then null else ts end as ts from {events}")
    return _placed(spark, oo.chronological(rows, "ts", "event_id")).select("event_id", "place")


@query("severity_order", "L7", """
select image_id, row_number() over (order by severity, month, image_id) as place from (
  select doc_id as image_id, case when toxic = 1 then 'HIGH' else 'MODERATE' end as severity, lpad((doc_id)::varchar, 12, '0') as month from labels) l""")
def severity_order(spark, sf_dir):
    rows = derive(spark, sf_dir, "select doc_id as image_id, case when toxic = 1 then 'HIGH' else 'MODERATE' end as severity, lpad(cast(doc_id as string), 12, '0') as month from {labels}")
    return _placed(spark, oo.by_severity(rows)).select("image_id", "place")


def _placed(spark, ordered):
    """Position of every row in an ordered table: partitions in their order, one count per partition."""
    path = scratch_path(spark, "ordered")
    ordered.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")).write.parquet(path)
    rows = spark.read.parquet(path)
    heads = rows.groupBy("_part").agg(F.count("*").alias("n"), F.min("_at").alias("first"))
    before = heads.alias("a").join(heads.alias("b"), F.col("b._part") < F.col("a._part"), "left").groupBy("a._part", "a.first").agg(
        F.coalesce(F.sum("b.n"), F.lit(0)).alias("before"))
    return rows.join(before, "_part").withColumn("place", F.col("before") + F.col("_at") - F.col("first") + 1)


@query("chat_export", "S9 F47 W14", r"""
with t as (select conv_id, turn, role, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') as said from {conversations})
select 'c' || conv_id as title, count(*) filter (said <> '') as messages, coalesce(sum(length(said)) filter (said <> ''), 0)::bigint as chars,
  coalesce(string_agg(role, '|' order by turn) filter (said <> ''), '') as roles from t group by conv_id""")
def chat_export(spark, sf_dir):
    """All conversations as one JSON array in one file, read back by many tasks and walked along their current path."""
    c = table(spark, sf_dir, "conversations")
    key = lambda t: F.concat(F.lit("n"), t.cast("string"))
    said = F.struct(F.struct("role").alias("author"), F.struct(F.lit("text").alias("content_type"), F.array(F.coalesce("text", F.lit(""))).alias("parts")).alias("content"))
    node = F.struct(key(F.col("turn")).alias("id"), F.when(F.col("turn") > F.col("first"), key(F.col("turn") - 1)).alias("parent"), said.alias("message"))
    ends = c.groupBy("conv_id").agg(F.min("turn").alias("first"), F.max("turn").alias("last"))
    rows = c.join(ends, "conv_id").groupBy("conv_id", "last").agg(F.map_from_entries(F.collect_list(F.struct(key(F.col("turn")), node))).alias("mapping"))
    export = F.to_json(F.struct(F.concat(F.lit("c"), "conv_id").alias("title"), key(F.col("last")).alias("current_node"), "mapping"))
    # one file: an opening bracket, the elements with a comma before all but the first, a closing bracket
    lines = rows.select(F.col("conv_id").alias("k"), export.alias("value"))
    least = lines.agg(F.min("k")).first()[0]
    lines = lines.select("k", F.when(F.col("k") > least, F.concat(F.lit(","), "value")).otherwise(F.col("value")).alias("value"))
    frame = spark.createDataFrame([(-1, "["), (2**62, "]")], "k long, value string")
    out = scratch_path(spark, "export")
    lines.unionByName(frame).coalesce(1).sortWithinPartitions("k").select("value").write.text(out)
    read = oc.current_path(ar.read_chat_export(spark, out))
    chars = F.aggregate("messages", F.lit(0).cast("long"), lambda n, m: n + F.length(m["text"]))
    return read.select("title", F.size("messages").alias("messages"), chars.alias("chars"), F.transform("messages", lambda m: m["role"]).alias("roles"))
