"""Cases that a review of the third round found."""

import gc

from pyspark.sql import functions as F

from hearthbook.functions import names as fn, text as ft
from hearthbook.operators import graph as og, reports
from hearthbook.sources import archive as ar, articles as sa, html as h
from hearthbook.streaming import flows


def test_long_numbers_above_the_mark_are_no_phones(spark):
    body = F.lit("the parts of order 30000007\n--\nManager of Sales\n555-010-2345")
    row = spark.range(1).select(ft.signature(body, mark_first=True)["phone"].alias("p"), ft.signature(F.lit("call 5550100"), mark_first=True)["phone"].alias("q")).first()
    assert (row["p"], row["q"]) == ("555-010-2345", "5550100")


def test_names_in_other_scripts_and_blanks(spark):
    rows = [("12\n",), (" Labs",), ("a\x0bbcd",), ("\u3000ab",), ("ΟΔΟΣß",), ("ABİC",)]
    df = spark.createDataFrame(rows, "name string")
    name = F.col("name")
    got = {r.name: (r.good, r.company, r.blocked) for r in df.select(
        "name", fn.quality_entity(name).alias("good"), fn.quality_entity(name, "company").alias("company"), fn.blocked_person(name).alias("blocked")).collect()}
    assert got == {"12\n": (False, False, False), " Labs": (True, False, False), "a\x0bbcd": (True, False, False),
                   "\u3000ab": (False, False, True), "ΟΔΟΣß": (True, False, False), "ABİC": (False, False, False)}


def test_pages_are_freed_and_rows_handed_on_in_parts(spark, monkeypatch):
    def nodes():
        return sum(type(o) is h.Node for o in gc.get_objects())

    gc.collect()
    gc.disable()
    try:
        before = nodes()
        with h.parsed("<div><p>a<b>c</b></p></div>" * 50) as root:
            assert nodes() > before + 200
        del root
        assert nodes() <= before
    finally:
        gc.enable()
    pages = spark.createDataFrame([(i, f"<body><p>a{i}</p><a href='x'>b</a></body>") for i in range(30)], "page_id long, html string").coalesce(1)
    whole = sa.page_elements(pages).orderBy("page_id", "pos").collect()
    monkeypatch.setattr(sa, "PART_CHARS", 500)
    assert sa.page_elements(pages).orderBy("page_id", "pos").collect() == whole and len(whole) == 60


def test_media_are_listed_by_tasks(spark, write, tmp_path):
    for i in range(6):
        write(f"m/{i % 2}/b/{i} é%20.PnG", bytes.fromhex("89504E470D0A1A0A0000000D49484452") + (i + 1).to_bytes(4, "big") + bytes(3) + b"\x09", "wb")
    write("m/x.jpg", "abc")
    write("m/_hidden/y.jpg", "abc")
    got = ar.list_media(spark, str(tmp_path / "m"), with_size=True)
    assert sorted((r.name, r.length, r.width, r.height) for r in got.collect()) == [
        *[(f"{i} é%20.PnG", 24, i + 1, 9) for i in range(6)], ("x.jpg", 3, None, None)]
    assert not any(f.endswith("PnG") for f in got.inputFiles())  # no file index of the driver holds them
    flat = ar.list_media(spark, "file:" + str(tmp_path / "m"), recursive=False).collect()
    assert [r.name for r in flat] == ["x.jpg"] and flat[0].mod_time.year > 2000


def test_look_up_settings_hold_inside_only(spark):
    names = [f"spark.sql.sources.parallelPartitionDiscovery.{k}" for k in ("parallelism", "threshold")]
    before = [spark.conf.get(n) for n in names]
    with flows.quick_look_up(spark, "/tmp/x"):
        assert int(spark.conf.get(names[0])) <= 4 * spark.sparkContext.defaultParallelism and int(spark.conf.get(names[1])) > 1_000_000
    with flows.quick_look_up(spark, "hdfs://h/x"):
        assert spark.conf.get(names[1]) == before[1]
    assert [spark.conf.get(n) for n in names] == before


def test_pairs_of_subjects_are_dealt_to_many_parts(spark):
    df = spark.range(4000).selectExpr("concat('a long subject ', id % 300) as s", "id % 7 as m")
    members = og.subject_members(df, "s", "m")
    assert members.count() == 2100 and members.rdd.getNumPartitions() >= 8 * spark.sparkContext.defaultParallelism
    assert og.edge_weights(og.cooccurrence_pairs(og.member_groups(members))).agg(F.sum("weight")).first()[0] == 300 * 21


def test_family_totals_classify_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def kind(x):
        calls.add(1)
        return {0: "alpha", 1: "beta", 2: "other"}[x % 3]

    df = spark.range(30).select(F.udf(kind)("id").alias("category"))
    got = reports.family_totals(df, "category", {"alpha": "greek", "beta": "greek"}).collect()
    assert sorted((r.family, r.category or "", r.n) for r in got) == [("greek", "", 20), ("greek", "alpha", 10), ("greek", "beta", 10)]
    assert calls.value == 30


def test_plain_addresses_and_headers_read_without_the_parser_as_with_it(monkeypatch):
    import email.header
    import email.utils
    import random
    from hearthbook.sources import mail
    rng = random.Random(7)
    pieces = ["Ann", " ", "  ", ", ", ",\n ", "a@b.example", "<x_1@y.example>", "<", ">", "@", ".", "-", '"', "(c)", "ü", ";", ":", "9", "=?utf-8?q?x?="]
    for _ in range(20000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(9)))
        assert mail._addresses(text) == email.utils.getaddresses([text]) and mail._sender(text) == email.utils.parseaddr(text)
    monkeypatch.setattr(email.utils, "getaddresses", None)
    monkeypatch.setattr(email.header, "decode_header", None)
    raw = "From M\nFrom: Ann Lee <A@b.example>\nTo: me@own.example,\n C <c@d.example>\nSubject: Plain\n\nbody"
    got = mail._message(raw)
    assert (got["sender"], got["sender_name"], [(p["name"], p["addr"]) for p in got["recipients"]]) == (
        "a@b.example", "Ann Lee", [("", "me@own.example"), ("C", "c@d.example")])


def test_signatures_split_a_body_once_and_trimming_stays(spark):
    body = spark.createDataFrame([("a  ",), (" \x0b a\n\u0085",), ("On Monday x wrote:\nb",), ("a\n > b\n\nc\n",), (None,)], "c string")
    plan = body.select(ft.signature(F.col("c"), mark_first=True).alias("s"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("split(") == 1
    plain = F.regexp_replace("c", r"^\s+|\s+$", "")
    assert body.filter(~ft.strip(F.col("c")).eqNullSafe(plain)).count() == 0
    assert [r[0] for r in body.select(ft.strip_replies(F.col("c"))).collect()][2:] == ["", "a\nc", None]


def test_entity_values_are_found_once_a_text_and_products_as_by_the_pattern(spark):
    from hearthbook.functions import entities as fe
    from hearthbook.rulesets import entities as ent
    calls = spark.sparkContext.accumulator(0)

    def look(x):
        calls.add(1)
        return [f"{x}{i % 30}" for i in range(40)]

    found = F.udf(look, "array<string>")
    rows = spark.createDataFrame([("a",), ("B",)], "c string")
    assert [len(r[0]) for r in rows.select(ft.dedup_ci(found("c"))).collect()] == [30, 30] and calls.value == 2
    plan = rows.select(ft.dedup_ci(F.split("c", "")).alias("s"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("split(") == 1
    texts = spark.createDataFrame([("new NIKE air max",), ("a\nGarden chair $5\nb",), ("xfOrd kit\nTall lamp  $9",), ("plain",), ("$5\nNo price",), ("Kenzo nikon z-9",), ("",), (None,)], "c string")
    plain = F.transform(ft.all_matches(F.col("c"), ent.PRODUCT), lambda p: ft.strip(F.regexp_replace(p, r"\s*\n\s*", " ")))
    got = texts.select(fe.extract_products(F.col("c")).alias("got"), ft.dedup_ci(plain).alias("want")).collect()
    assert [r.got for r in got] == [r.want or [] for r in got] and sum(len(r.got) for r in got) == 4
    people = texts.limit(1).select(F.explode(fe._groups(F.lit("Liked by ann and Followed by bob\nMary Poppins\nBILLED TO: Jo Lee\n@shop_one Following"), ent.PERSON, 5)))
    assert [r[0] for r in people.collect()] == ["ann", "bob", "Mary Poppins", "Jo Lee", "shop_one"]
