"""Operators against brute force, with one group that holds a third or more of all rows."""

import random
import re

import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from hearthbook.functions import entities as fe, media as fm, names as fn, render, text as ft
from hearthbook.functions.prefilter import pieces
from hearthbook.operators import linkage as ol, media as om, ordering as oo, sessions as os_, entities as oe
from hearthbook.plans import pipelines as pl
from hearthbook.rulesets import chat, entities as ent, ocr, timeline
from hearthbook.streaming import flows


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(7)
    rows = [("hot" if i % 5 < 2 else f"k{rng.randrange(40)}", i, rng.randrange(2_000_000), "x" * rng.randrange(400)) for i in range(4000)]
    return pd.DataFrame(rows, columns=["k", "id", "t", "body"])


def test_positions_and_totals(spark, skewed):
    df = spark.createDataFrame(skewed)
    got = oo.number_rows(df, ["k"], [F.asc("id")], F.shiftright("id", 6), "pos").select("id", "pos").toPandas().set_index("id")["pos"]
    want = skewed.sort_values("id").groupby("k").cumcount() + 1
    assert (got.sort_index().values == want.sort_index().values).all()
    used = oo.running_before(df, ["k"], [F.asc("id")], F.length("body"), F.shiftright("id", 6), "u").select("id", "u").toPandas().set_index("id")["u"]
    lens = skewed.sort_values("id").body.str.len()
    before = lens.groupby(skewed.k).cumsum() - lens
    assert (used.sort_index().values == before.sort_index().values).all()


def test_sample_and_budget(spark, skewed):
    df = spark.createDataFrame(skewed)
    got = {(r["k"], r["id"]) for r in oo.stratified_sample(df, ["k"], "id", "body", slice_by=F.shiftright("id", 6)).collect()}
    want = set()
    for k, g in skewed.sort_values("id").groupby("k"):
        ids, n = list(g.id), len(g)
        if n <= 20:
            want |= {(k, i) for i in ids}
            continue
        middle = ids[5:-5]
        step = max(1, len(middle) // 10)
        longest = g.loc[g.body.str.len().idxmax(), "id"]
        want |= {(k, i) for i in ids[:5] + ids[-5:] + middle[::step][:10] + [longest]}
    assert got == want
    cut = oo.char_budget(df, ["k"], "id", "body", 5000, F.shiftright("id", 6)).toPandas()
    assert cut.groupby("k").body.apply(lambda s: s.str.len().sum()).max() == 5000


def test_sessions_with_and_without_key(spark, skewed):
    df = spark.createDataFrame(skewed).withColumn("ts", F.timestamp_seconds("t").cast("timestamp_ntz"))
    for keys in (["k"], []):
        got = os_.sessionize(df, "ts", 900, keys).select("id", F.unix_seconds(F.col("session_start").cast("timestamp")).alias("s")).toPandas().set_index("id")["s"]
        want = {}
        groups = skewed.groupby("k") if keys else [("", skewed)]
        for _, g in groups:
            start = prev = None
            for t, i in sorted(zip(g.t, g.id)):
                if prev is None or t - prev > 900:
                    start = t
                want[i], prev = start, t
        assert got.to_dict() == want


def test_gap_edge_stays_together(spark):
    df = spark.createDataFrame([(1, 0), (2, 7200), (3, 14401)], "id int, t long").withColumn("ts", F.timestamp_seconds("t").cast("timestamp_ntz"))
    got = {r["id"]: r["n"] for r in os_.sessionize(df, "ts", 7200).select("id", F.unix_seconds(F.col("session_start").cast("timestamp")).alias("n")).collect()}
    assert got == {1: 0, 2: 0, 3: 14401}


def _norm(s):
    return " ".join(re.sub(r"[^a-z\s]", "", s.lower()).split())


def _lev(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(cur[-1] + 1, prev[j] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def _score(a, b):
    a, b = _norm(a), _norm(b)
    if not a or not b:
        return 0.0
    if a == b:
        return 100.0
    p, q = a.split(), b.split()
    if len(p) >= 2 and len(q) >= 2 and p[-1] == q[-1]:
        return 95.0 if p[0] == q[0] else 85.0 if p[0][:3] == q[0][:3] else 70.0
    return max(0.0, (1 - _lev(a, b) / max(len(a), len(b))) * 100)


def test_fuzzy_match_equals_all_pairs(spark):
    rng = random.Random(3)
    first, last = ["ann", "anna", "bob", "carla", "dee", "jo"], ["smith", "smyth", "lee", "leigh", "o'hara", "stone"]
    pages = sorted({f"{rng.choice(first)} {rng.choice(last)}".title() for _ in range(25)} | {"Madonna", "Bo"})
    left = [f"{rng.choice(first)} {rng.choice('abc')}. {rng.choice(last)}" for _ in range(20)]
    left += ["".join(c for c in rng.choice(pages) if rng.random() > 0.15) for _ in range(60)] + ["madona", "zzz qqq", "b"]
    names = spark.createDataFrame([(p, p, i) for i, p in enumerate(pages)], "page string, name string, rank int")
    got = {r["n"]: (r["matched_page"], round(r["score"], 6)) for r in ol.fuzzy_match(
        spark.createDataFrame([(x,) for x in left], "n string"), names, "n", "name", "page", "rank").collect() if r["score"] >= 60}
    want = {}
    for x in set(left):
        s = max((round(_score(x, p), 6), -i) for i, p in enumerate(pages))
        if s[0] >= 60:
            want[x] = (pages[-s[1]], s[0])
    assert got == want


@pytest.mark.parametrize("a,b,score", [("Ann Lee", "ann lee!", 100), ("Ann B Lee", "Ann Lee", 95), ("Anna Lee", "Annika Lee", 85), ("Bo Lee", "Ann Lee", 70), ("", "x", 0)])
def test_name_score(spark, a, b, score):
    assert spark.range(1).select(fn.name_match_score(F.lit(a), F.lit(b)).alias("s")).first()["s"] == score


def test_dictionary_finds_what_texts_contain(spark):
    rng = random.Random(5)
    texts = [("".join(rng.choice("abcd ") for _ in range(200)),) for _ in range(60)]
    rows = [(i % 50, t) for i, (t,) in enumerate(texts)] + [(90, None), (91, "")]  # ten ids stand for two texts
    docs = spark.createDataFrame(rows, "id long, text string")
    keys = sorted({t[0][i:i + n].strip() for t in texts[:20] for i, n in ((3, 5), (50, 7)) if len(t[0][i:i + n].strip()) >= 4} | {"zzzz"})
    known = spark.createDataFrame([(k,) for k in keys], "key string")
    found = ol.match_dictionary(docs, "id", F.col("text"), known).collect()
    assert len(found) == len(set(found)) and {tuple(r) for r in found} == {(i, k) for i, t in rows for k in keys if t and k in t}
    names = ["Bo", "A", "Ann Lee", "aé"]
    said = spark.createDataFrame([(1, "Bo met Ann Lee"), (2, "bo aé"), (3, "A")], "id long, text string")
    got = ol.mentions(said, "id", F.col("text"), spark.createDataFrame([(n,) for n in names], "name string")).collect()
    assert sorted(map(tuple, got)) == [(1, "A"), (1, "Ann Lee"), (1, "Bo"), (2, "aé"), (3, "A")]


PATTERNS = ([p for r in ocr.DETAILED_RULES.values() for _, p in r] + [p for _, ps in ocr.REFINED_RULES.values() for p in ps]
            + [p for _, p in timeline.EVENT_RULES] + chat.SKIP_PATTERNS + [ent.EMAIL, ent.URL, ent.PRICE, ent.ADDRESS, ent.TODO, ent.BUSINESS])


@settings(max_examples=60, deadline=None)
@given(st.sampled_from(PATTERNS), st.data())
def test_prefilter_never_hides_a_match(pattern, data):
    found, folded = pieces(pattern)
    if not found:
        return
    text = data.draw(st.from_regex(re.compile(pattern), fullmatch=False))
    if re.search(pattern, text):
        assert any(p in (text.lower() if folded else text) for p in found)


def _entities(spark, text, category=None):
    df = spark.createDataFrame([(1, text, category)], "id int, text string, category string")
    return oe.entities_wide(df, "text", "category").first().asDict()


def test_entity_kinds(spark):
    e = _entities(spark, "9:41 LTE @\nSarah Jones\nLiked by maria\nCall (212) 555-0123 now, 1200 followers 2125550199\nNike Air Max for $89.99 or $1.2K\n"
                  "@some_one Follow\nneed to buy the green milk soon\nMay 3, 2024 at 12 Old Mill Road\nsee https://a.example/x and www.b.example\n\"A quoted sentence that is long enough to count\"\n42", "Food / Restaurants")
    assert e["phones"] == ["(212) 555-0123"] and e["prices"] == ["$89.99", "$1.2K"] and e["handles"] == ["@some_one"]
    assert e["dates_mentioned"] == ["May 3, 2024"] and e["addresses"] == ["2024 at 12 Old Mill Road"] and "Nike Air Max" in e["products"][0]
    assert e["people"] == ["Sarah Jones", "maria", "Nike Air", "some_one", "@some_one"] and e["quotes"] == ["A quoted sentence that is long enough to count"]
    assert e["services"][0] == "Sarah Jones" and e["contacts"] == [] and e["urls"][:2] == ["https://a.example/x", "www.b.example"]
    assert any(t.startswith("need to buy") for t in e["todos"])
    chat_ = _entities(spark, "Maria Bell\nhello there", "WhatsApp")
    assert chat_["contacts"] == ["Maria Bell"]


def test_replies_and_signature(spark):
    body = "Hi\n> old\n\nmore\nFrom: me only\n\nFrom: x\n\nSent: y\nrest\n--\nVP of Art\n"
    row = spark.range(1).select(ft.strip_replies(F.lit(body)).alias("b"), ft.signature(F.lit(body)).alias("s")).first()
    assert row["b"] == "Hi\nmore\nFrom: me only" and row["s"]["title"] == "VP of Art" and row["s"]["phone"] is None


def test_long_names_are_cut_to_bytes(spark):
    df = spark.createDataFrame([(1, "d", "é" * 200 + ".jpg"), (2, "d", "é" * 200 + ".jpg")], "id int, dir string, name string")
    names = sorted(r["dest_name"] for r in oo.unique_destinations(df, "dir", "name", [F.asc("id")], F.shiftright("id", 4)).collect())
    assert len(set(names)) == 2 and all(len(n.encode()) <= 255 for n in names)


def test_media_plan(spark):
    rows = [(f"p{i}.jpg", ".jpg", 4000, 3000, True, 1_700_000_000 + t, 1.0) for i, t in enumerate((0, 60, 7260, 20000, 20100))]
    media = spark.createDataFrame([(f"/m/{n}", *r) for n, *r in [(r[0], *r) for r in rows]], "path string, name string, ext string, width int, height int, has_camera boolean, t long, lat double")
    media = media.withColumn("taken_at", F.timestamp_seconds("t").cast("timestamp_ntz")).withColumn("lon", F.lit(2.0))
    out = pl.media_organisation(media)
    ev = out["events"].collect()
    assert len(ev) == 1 and ev[0]["members"] == 3 and ev[0]["duration"] == "2h 1m" and ev[0]["folder"] == "Event_001__2023-11-14_2213__2h1m"
    assert out["placed"].count() == 5 and out["gps"].first()["with_gps"] == 5


def test_placement_manifest(spark):
    files = spark.createDataFrame([("/d/Acme Corp/a.txt", ""), ("/d/docs/a.txt", "an invoice and a receipt"), ("/d/files/a.txt", "invoice receipt"), ("/d/docs/b.jpg", "")], "path string, text string")
    files = files.withColumn("mod_time", F.lit("2024-05-01").cast("timestamp"))
    empty = spark.createDataFrame([], "key string, display string")
    got = {r["source"]: r["destination"] for r in pl.document_placement(files, empty, empty, empty, "/d").collect()}
    assert got["/d/Acme Corp/a.txt"] == "Projects/Acme_Corp/a.txt" and got["/d/docs/b.jpg"] == "Image/2024-05/b.jpg"
    assert {got["/d/docs/a.txt"], got["/d/files/a.txt"]} == {"Finance/2024-05/a.txt", "Finance/2024-05/a_1.txt"}


def test_hero_selection(spark):
    files = spark.createDataFrame([("w1", "2020 - Blue Door", "Photos", "blue door front.jpg", 5_000_000), ("w1", "2020 - Blue Door", "", "IMG_1.jpg", 10)], "work_id string, work string, folder string, name string, size long")
    works = spark.createDataFrame([("w1",), ("w2",)], "work_id string")
    sel = spark.createDataFrame([("w1", "Photos/blue door front.jpg"), ("w9", "x")], "work_id string, choice string")
    out = pl.hero_selection(files, works, sel)
    assert {r["name"]: (r["score"], r["rank"]) for r in out["ranked"].collect()} == {"blue door front.jpg": (22, 1), "IMG_1.jpg": (-2, 2)}
    assert {r["work_id"]: r["status"] for r in out["status"].collect()} == {"w1": "picked", "w2": "pending", "w9": "unknown_work"}


def test_ocr_knowledge(spark):
    texts = spark.createDataFrame([("s1", "2025-10", "Order placed: receipt total\nJane Roe\nmail jane@x.example call 212-555-0123 $5.00"), ("s2", "2025-09", "nothing much here")], "stem string, month string, text string")
    out = pl.ocr_knowledge(texts, oe.merge_table(spark, {"jane roe": "Jane Q. Roe"}), "2025-11-01")
    who = {r["name"]: r for r in out["profiles"].collect()}["Jane Q. Roe"]
    assert (who["recency"], who["repetition"], who["contactability"], who["relevance"], who["confidence"]) == (4, 1, 5, 2, 3)
    note = {r["stem"]: r["note"] for r in out["notes"].collect()}["s1"]
    assert 'emails: ["jane@x.example"]' in note and "[[Categories/Receipts - Purchases]]" in note


def test_parse_response_and_update(spark):
    df = spark.createDataFrame([('```json\n{"relationship_type": "peer"}\n```',), ("no",)], "t string").select(render.parse_response(F.col("t")).alias("p"))
    a, b = [r["p"] for r in df.collect()]
    assert a["relationship_type"] == "peer" and a["error"] is None and b["error"] == "JSON parse error" and b["raw"] == "no"
    page = "---\ntype: person\nlast_updated: 2020-01-01\n---\n\n# Ann\n"
    one = spark.range(1).select(render.person_update(F.lit(page), F.lit("\n## Email archive context"), F.lit("a@x"), "2024-01-01").alias("c")).first()["c"]
    assert "email_contact: a@x\n---" in one and "last_updated: 2024-01-01" in one
    two = spark.range(1).select(render.person_update(F.lit(one), F.lit("\n## Email archive context"), F.lit("a@x"), "2025-01-01").alias("c")).first()["c"]
    assert two == one


def test_stream_of_text_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("Gmail Inbox $5.00 receipt")
    (tmp_path / "in" / "empty.txt").write_text("")
    run = lambda: flows.stream_classify(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "log"), ["prices"]).awaitTermination()
    run()
    (tmp_path / "in" / "b.txt").write_text("whatsapp chat")
    run()
    rows = {r["stem"]: (r["category"], r["prices"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert rows == {"a": ("Receipts / Purchases", ["$5.00"]), "b": ("WhatsApp", [])}


def test_positions_and_detections(spark):
    row = spark.range(1).select(fm.dms_to_decimal(F.array(F.lit(10.0), F.lit(30.0), F.lit(36.0)), F.lit("W")).alias("x")).first()["x"]
    assert abs(row + 10.51) < 1e-9
    d = spark.createDataFrame([("a", "BUTTOCKS_EXPOSED", 0.5), ("a", "ANUS_EXPOSED", 0.9), ("b", "BUTTOCKS_EXPOSED", 0.49)], "image_id string, label string, score double")
    assert [tuple(r) for r in om.detection_severity(d, 0.5).collect()] == [("a", "HIGH", 2)]


def test_caps_can_be_lifted(spark):
    text = "\n".join(f"need to buy item number {i}" for i in range(15))
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(F.size(fe.extract_todos(F.col("t"))).alias("n")).first()["n"] == 10
    assert df.select(F.size(fe.extract_todos(F.col("t"), None)).alias("n")).first()["n"] == 15
