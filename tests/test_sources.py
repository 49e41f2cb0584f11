"""Readers and writers on small hand-made files."""

import json
import struct
import zlib

from pyspark.sql import functions as F

from hearthbook.operators import press as op
from hearthbook.plans import pipelines as pl
from hearthbook.sinks import writers as wr
from hearthbook.sources import archive as ar, articles as sa, mail as sm, social as ss
from hearthbook.operators import contacts as ct, graph as og

OWN = ["me@own.example"]

MBOX = """From a@x Mon Jan  1 00:00:00 2024
From: Ann Lee <Ann@People.example>
To: me@own.example, "Bo Ray" <bo@people.example>
Cc: cy@people.example
Subject: =?utf-8?b?SMOpbGxv?= plan
Date: Tue, 2 Jan 2024 10:05:00 -0500
Message-ID: <1@x>

Hello there, this is a body that is long enough to keep.
> quoted

On Mon, Bo wrote:
old text
--
Director of Plans
+1 212 555 0199

From b@x Mon Jan  1 00:00:00 2024
From: me@own.example
To: Ann@people.example
Subject: Re: plan
Date: 3 Jan 2024 11:00:00 +0000
Message-ID: <2@x>
Content-Type: multipart/alternative; boundary="b1"

--b1
Content-Type: text/html; charset=utf-8

<html><style>p{}</style><p>An answer with &amp; in markup, long enough.</p><div>two</div></html>
--b1--

From c@x Mon Jan  1 00:00:00 2024
From: noreply@shop.example
To: me@own.example
Subject: sale
List-Unsubscribe: <mailto:x>

buy
"""


def test_mail_to_bundles(spark, write):
    msgs = sm.read_mbox(spark, write("mail.mbox", MBOX), "acct").cache()
    rows = {r["subject"]: r for r in msgs.collect()}
    assert set(rows) == {"Héllo plan", "Re: plan", "sale"}
    first = rows["Héllo plan"]
    assert first["sender"] == "ann@people.example" and str(first["ts"]) == "2024-01-02 10:05:00"
    assert [p["addr"] for p in first["recipients"]] == ["me@own.example", "bo@people.example", "cy@people.example"]
    assert "An answer with & in markup" in rows["Re: plan"]["body"] and "p{}" not in rows["Re: plan"]["body"]

    known = sm.read_contacts(spark, write("contacts.csv", "email\n ANN@people.example\nbo@people.example \nme@own.example\n"))
    cm = ct.contact_messages(msgs, known, OWN)
    got = sorted((r["contact"], r["direction"], r["body"][:11], r["phone_sig"], r["title_sig"]) for r in cm.collect())
    assert got == [
        ("ann@people.example", "from", "Hello there", "+1 212 555 0199", "Director of Plans"),
        ("ann@people.example", "to", "An answer w", None, None),
        ("bo@people.example", "cc", "", None, None),
    ]
    ann = {r["email"]: r for r in ct.contact_rollup(cm, "acct").collect()}["ann@people.example"]
    assert (ann["total_emails"], ann["emails_from"], ann["emails_to"], ann["emails_sampled"]) == (2, 1, 1, 2)
    assert ann["display_names"] == ["Ann Lee"] and ann["unique_subjects"] == ["Héllo plan", "Re: plan"]
    assert ann["threads"][0]["body_snippet"] == "Hello there, this is a body that is long enough to keep."


def test_address_sources(spark, write):
    vcf = write("c.vcf", "BEGIN:VCARD\nEMAIL;TYPE=HOME:Ann@People.example\nemail:a@b\nEMAIL:nobody\nEND:VCARD\n")
    assert [r["email"] for r in sm.read_vcf_emails(spark, vcf).collect()] == ["ann@people.example"]
    head = "First Name,Last Name,Organization Name,Phone 1 - Value,E-mail 1 - Value,E-mail 2 - Value\n"
    book = write("book.csv", head + "Ann,Lee,Old Org,1,ann@people.example,\nAnn,Lee,New Org,,Ann@People.example,second@people.example\n")
    rows = {r["email"]: r for r in sm.read_address_book(spark, book).collect()}
    assert set(rows) == {"ann@people.example", "second@people.example"}
    assert rows["ann@people.example"]["gc_org"] == "New Org" and rows["ann@people.example"]["gc_phone"] is None
    assert rows["second@people.example"]["gc_name"] == "Ann Lee"
    crm = write("crm.csv", "Email,Collector Name,City,State/Province,Net Sales ($)\nANN@people.example,Ann L,Rome,,\"1,200\"\n,x,,,\n")
    crm_rows = sm.read_crm(spark, crm).collect()
    assert len(crm_rows) == 1 and crm_rows[0]["crm_net_sales"] == "1,200" and crm_rows[0]["crm_state"] is None


def _bundle(email, n, subjects, account="a", **more):
    return json.dumps({"email": email, "display_names": ["Name " + email[0]], "total_emails": n, "emails_from": n // 2, "emails_to": n // 2, "emails_cc": 0,
                       "first_contact": "2015-02-03T10:00:00", "last_contact": "2023-05-06T07:00:00", "unique_subjects": subjects, "source_account": account,
                       "threads": [{"date": "2020-01-02T03:04:05", "subject": "Invoice for the plan", "direction": "from", "body_snippet": "b"}], **more})


def test_bundles_results_and_graph(spark, write, tmp_path):
    write("b/a.json", _bundle("a@x.example", 30, ["shared subject one", "shared subject two"]))
    write("b/b.json", _bundle("b@x.example", 4, ["Shared Subject One", "shared subject two", "short"]))
    write("b/manifest.json", _bundle("m@x.example", 1, []))
    write("b/broken.json", "{not json")
    write("b/none.json", json.dumps({"total_emails": 3}))
    bundles = sm.read_bundles(spark, str(tmp_path / "b"))
    assert sorted(r["email"] for r in bundles.collect()) == ["a@x.example", "b@x.example"]
    write("r/results_1.json", json.dumps([{"email": "A@x.example", "relationship_type": "press"}, {"email": "b@x.example", "error": "bad"}]))
    write("r/results_2.json", json.dumps({"a@x.example": {"relationship_type": "family", "key_topics": ["t"]}}))
    write("r/results_3.json", "oops")
    results = sm.read_enrichments(spark, str(tmp_path / "r"))
    assert {r["email"]: r["relationship_type"] for r in results.collect()} == {"a@x.example": "family", "b@x.example": None}
    full = ct.with_enrichment(bundles, results).withColumn("org", F.lit("")).withColumn("name", F.get("display_names", F.lit(0))).withColumn("pos", F.lit(1))
    graph = pl.relationship_graph(full)
    edge = graph["edges"].collect()
    assert [(e["source"], e["target"], e["weight"], e["shared_subjects"]) for e in edge] == [
        ("a@x.example", "b@x.example", 2, ["shared subject one", "shared subject two"])]
    assert graph["stats"].first().asDict() == {"total_nodes": 2, "total_edges": 1}
    events = pl.timeline(bundles)["events"].collect()
    assert [(str(e["date"]), e["event_type"]) for e in events] == [("2020-01-02", "financial")]
    wr.write_graph(graph["nodes"], graph["edges"], graph["stats"], str(tmp_path / "g"))
    assert spark.read.json(str(tmp_path / "g" / "edges")).count() == 1
    wr.write_bundles(bundles, str(tmp_path / "out"), 4)
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    assert og.degree(graph["edges"]).count() == 2


def test_contact_360_and_pages(spark, write, tmp_path):
    msgs = sm.read_mbox(spark, write("mail.mbox", MBOX))
    known = spark.createDataFrame([("ann@people.example",)], "email string")
    book = sm.read_address_book(spark, write("book.csv", "First Name,Last Name,E-mail 1 - Value\nAnne,Lee,ann@people.example\n"))
    crm = sm.read_crm(spark, write("crm.csv", "Email,City\nann@people.example,Rome\n"))
    write("people/Ann Leigh.md", "---\ntype: person\nlast_updated: 2020-01-01\naliases:\n  - Ann Lee\n---\n\n# Ann\n")
    write("people/Plain.md", "no frontmatter")
    people = ar.read_people_notes(spark, str(tmp_path / "people"), str(tmp_path / "people"))
    assert {r["page"]: r["aliases"] for r in people.collect()} == {"Ann Leigh": ["Ann Lee"], "Plain": []}
    write("r/results_1.json", json.dumps([{"email": "ann@people.example", "relationship_type": "press", "role_title": "Editor"}]))
    results = sm.read_enrichments(spark, str(tmp_path / "r"))
    master = pl.contact_360(msgs, known, OWN, book, crm, ar.page_names(people), results, "2024-01-10", "acct").collect()
    assert len(master) == 1
    row = master[0]
    assert row["name"] == "Anne Lee" and row["vault_page"] == "Ann Leigh" and row["vault_match_status"] == "confirmed"
    assert row["city"] == "Rome" and row["role_title"] == "Editor" and row["has_enrichment"] is True
    assert row["relationship_strength"] == 86 and row["communication_gap_days"] == 6
    again = pl.merge_masters([spark.createDataFrame([r.asDict() for r in master], "name string, email string, phone string, organization string, role_title string, city string, state string, relationship_summary string, relationship_type string, relationship_strength int, key_topics string, projects_in_common string, notable_context string, communication_style string, total_emails long, emails_from long, emails_to long, first_contact timestamp_ntz, last_contact timestamp_ntz, communication_gap_days int, source_account string, vault_page string, vault_match_status string, collector_type string, collector_priority string, total_purchases string, products_purchased string, gc_website string, gc_birthday string, enrichment_tier string, has_enrichment boolean")] * 2, "2024-01-10").first()
    assert again["total_emails"] == 4 and again["emails_from"] == 2
    wr.write_master(spark.createDataFrame([(1, "x", "e")], "total_emails int, name string, email string"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["name", "email", "total_emails"]


def test_chat_export_takes_current_branch(spark, write, tmp_path):
    def node(parent, role=None, parts=None):
        return {"id": "x", "parent": parent, "children": [], "message": role and {"author": {"role": role}, "create_time": 1.0, "content": {"parts": parts}}}
    tree = {"root": node(None), "u": node("root", "user", ["Tax  plan"]), "dead": node("u", "assistant", ["unused"]),
            "a": node("u", "assistant", ["Answer", {"content_type": "text", "text": "more"}, {"content_type": "image"}]), "u2": node("a", "user", [" thanks "])}
    conv = [{"title": "Tax and travel", "create_time": 1704067200, "current_node": "u2", "mapping": tree},
            {"title": "New chat", "create_time": 1704067200, "current_node": "u2", "mapping": tree},
            {"title": "Short tax", "create_time": None, "current_node": "a", "mapping": {"r": node(None), "a": node("r", "user", ["hi"])}},
            {"title": "Lost", "create_time": None, "current_node": None, "mapping": tree}]
    path = write("conversations.json", json.dumps(conv))
    out = pl.chat_index(ar.read_chat_export(spark, path))
    rows = sorted((r["domain"], r["title"], r["date"], r["user_messages"], r["key_responses"], r["message_count"]) for r in out["topics"].collect())
    assert rows == [(d, "Tax and travel", "2024-01-01", ["Tax  plan", "thanks"], ["Answer\nmore"], 3) for d in ("finance", "life_personal")]
    wr.write_domains(out["topics"], str(tmp_path / "domains"))
    assert (tmp_path / "domains" / "domain=finance").exists()


WALL = """<html><body><div class="feedentry"><span class="fn">Ann Lee</span> <span class="entry-content">Hi <a href="http://x">link</a></span>
<abbr class="time published" title="2011-05-01T10:00:00+0000">May 1</abbr><div class="comments"><div class="comment"><span class="fn">Bo</span><span class="entry-content">yes</span>
<abbr class="time">May 2</abbr></div></div></div><div class="feedentry"><span class="entry-content">anon</span></div></body></html>"""
MESSAGES = """<div class="thread"><div class="message"><span class="fn">Ann Lee</span><abbr class="time" title="2012-01-02T10:00:00+0000">later</abbr><div class="msgbody">let's catch up soon, my startup<br>grows</div></div>
<div class="message"><span class="fn">Me</span><abbr class="time" title="2012-01-01T10:00:00+0000">first</abbr><div class="msgbody">hello</div></div></div>
<div class="thread"><div class="message"><div class="msgbody">lost</div></div></div>"""


def test_social_pages(spark, write):
    wall = ss.read_social_wall(spark, write("wall.html", WALL)).orderBy("author").collect()
    assert [(w["author"], w["content"], str(w["ts"])) for w in wall] == [("Ann Lee", "Hi [link](http://x)", "2011-05-01 10:00:00"), ("Unknown", "anon", "None")]
    assert wall[0]["comments"][0].asDict() == {"author": "Bo", "content": "yes", "time": "May 2"}
    msgs = ss.read_social_messages(spark, write("messages.html", MESSAGES), "Me")
    rows = msgs.orderBy("name", "pos").collect()
    assert [(r["name"], r["pos"], r["author"], r["body"]) for r in rows] == [
        ("Ann Lee", 0, "Me", "hello"), ("Ann Lee", 1, "Ann Lee", "let's catch up soon, my startup\ngrows"), ("Unknown", 0, "Unknown", "lost")]
    ranking = pl.social_ranking(msgs, "Me", spark.createDataFrame([("Ann Lee",)], "title string"))["ranking"].collect()
    assert len(ranking) == 1
    r = ranking[0].asDict()
    assert (r["depth"], r["reciprocity"], r["professional"], r["followup_intent"], r["recency"], r["wall_presence"], r["substance"]) == (2, 15, 4, 6, 10, 5, 3)
    assert r["tags"] == ["Reconnect"] and r["snippet"] == "let's catch up soon, my startup grows" and r["tier"] == 1
    notes = ss.read_social_notes(spark, write("notes.html", '<div class="note"><h2 class="entry-title">T</h2><div class="notebody"><p>a <strong>b</strong></p><p>c</p></div></div>')).first()
    assert notes["title"] == "T" and notes["body"] == "a **b**\n\nc"
    event = ss.read_social_events(spark, write("events.html", '<div class="event"><h2>Party</h2><span class="fn">Ann</span><br>Main Hall ()<div class="description">x<br>y</div></div>')).first()
    assert (event["title"], event["host"], event["location"], event["description"]) == ("Party", "Ann", "Main Hall", "x\n\ny")
    friends = ss.read_social_friends(spark, write("friends.html", '<span class="fn">A</span><span class="fn">B</span>'))
    assert [f["name"] for f in friends.orderBy("pos").collect()] == ["A", "B"]
    album = ss.read_social_albums(spark, write("album-My%20Trip.html", '<div class="photo-container"><img class="photo" src="p.jpg"/>cap</div>')).first()
    assert (album["name"], album["photo_count"], album["photos"][0]["caption"]) == ("My Trip", 1, "cap")
    profile = ss.read_social_profile(spark, write("profile.html", '<table><tr><td class="profile_label">Family:</td><td><span class="fn">Bo</span> (brother)</td></tr><tr><td class="profile_label">City:</td><td>Rome</td></tr><tr><td class="profile_label">Interests:</td><td><span class="page">Art</span></td></tr></table>')).first()
    assert profile["fields"] == {"City": "Rome"} and profile["family"][0]["relationship"] == "brother" and profile["pages"] == {"Interests": ["Art"]}


def test_message_notes(spark, write):
    text = '---\nparticipants: ["Ann Lee"]\nmessage_count: 12\n---\n# Ann\n\n## May 1, 2011\n\n**[[Ann Lee]]** (10:00):\n> hello\n> there\n\n**Me** (10:01):\n> ok\n'
    note = ss.read_message_notes(spark, write("Ann.md", text), "Me").first()
    assert note["participants"] == ["Ann Lee"] and note["message_count"] == 12 and note["first_date"] == "May 1, 2011"
    assert note["other_messages"] == ["hello\n> there"] and note["owner_messages"] == ["ok"]


PAGE = """<html><head><title>Site | T</title><meta property="og:site_name" content="Site"><meta name="author" content="Meta Author"></head><body><nav>menu</nav>
<article class="x"><h1>Head</h1><div class="byline">By Ann Lee</div><time datetime="2024-03-12">March</time><p>First <b>para</b>.</p><div class="ad">buy</div><div style="display: none">hid</div><div></div>
<!-- c --><figure><img src="/i.jpg" width="300" height="200"><figcaption>Cap</figcaption></figure><figure><img src="https://x.example/pixel.gif"></figure><img data-src="//c.example/l.png" src="data:x"><blockquote>Q</blockquote><ul><li>one</li></ul></article></body></html>"""


def test_articles(spark):
    pages = spark.createDataFrame([(1, "https://news.example/a", PAGE)], "page_id long, url string, html string")
    a = sa.extract_articles(pages).first()
    assert (a["title"], a["author"], a["date"], a["sitename"]) == ("Head", "Ann Lee", "2024-03-12", "Site")
    for gone in ("menu", "buy", "hid", "pixel", "<!--", "class="):
        assert gone not in a["body_html"]
    assert 'src="https://news.example/i.jpg"' in a["body_html"] and "https://c.example/l.png" in a["body_html"]
    old = sa.extract_articles(pages, "archived").first()
    assert old["author"] == "Meta Author" and old["title"] == "Head"
    md = sa.html_to_markdown(pages).first()["body_md"]
    assert md.startswith("## Head") and "\n> Q" in md and "- one" in md and "![Cap](/i.jpg)\n*Cap*" in md
    imgs = sa.page_images(pages).orderBy("pos").collect()
    assert [(i["src"], i["kept"]) for i in imgs] == [("https://news.example/i.jpg", True), ("https://x.example/pixel.gif", False), ("https://c.example/l.png", True)]


def test_press_links_and_clean_pages(spark):
    html = '<body><p><a href="http://early.example/1">before 2009</a></p><h2>2019</h2><p>Story <a href="https://www.forbes.com/x">One</a></p><a href="/rel">r</a><a href="https://own.example/z">z</a><h2>2018</h2><a href="https://youtu.be/v">V</a><a href="https://www.forbes.com/x">again</a></body>'
    links = op.extract_press_links(sa.page_elements(spark.createDataFrame([(1, html)], "page_id long, html string")), "own.example")
    got = sorted((r["url"], r["year"], r["outlet"], r["is_video"], r["context"]) for r in links.collect())
    assert got == [("http://early.example/1", "2009", "earlyexample", False, "before 2009"), ("https://www.forbes.com/x", "2019", "forbes", False, "StoryOne"),
                   ("https://youtu.be/v", "2018", "youtube", True, got[2][4])] or got[2][:2] == ("https://youtu.be/v", "2018")
    page = '<h1>H</h1><div class="publication-name">Pub</div><div class="byline">By Ann · 2024-03-12</div><div class="article-body"><p>text</p></div><div class="original-link"><a href="http://o">o</a></div>'
    row = sa.parse_article_pages(spark.createDataFrame([(1, page)], "page_id long, html string")).first()
    assert (row["headline"], row["publisher"], row["author"], row["date"], row["url"], row["body_md"]) == ("H", "Pub", "Ann", "2024-03-12", "http://o", "text")


def _png(w, h):
    head = b"IHDR" + struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + head + struct.pack(">I", zlib.crc32(head))


def test_media_texts_rules_and_selections(spark, write, tmp_path):
    write("m/2024/a.PNG", _png(1170, 2532), "wb")
    write("m/2024/.hidden.png", _png(1, 1), "wb")
    media = ar.list_media(spark, str(tmp_path / "m"), with_size=True).collect()
    assert [(m["name"], m["ext"], m["width"], m["height"]) for m in media] == [("a.PNG", ".png", 1170, 2532)]
    write("ocr/Old Cat/2024-05/shot one.txt", "some text")
    t = ar.read_ocr_text(spark, str(tmp_path / "ocr")).first()
    assert (t["stem"], t["month"], t["old_category"], t["text"]) == ("shot one", "2024-05", "Old Cat", "some text")
    rules = ar.read_rules(spark, write("rules.txt", "# c\n\n(a|b)c|Cat one\nplain|Two\n"))
    assert sorted(map(tuple, rules.collect())) == [("(a|b)c", "Cat one"), ("plain", "Two")]
    sel, works = ar.read_selections(spark, write("s.json", json.dumps({"selections": {"w1": "a.jpg", "w2": "__SKIP__"}, "works": [{"id": "w1", "rel_path": "p", "candidates": []}]})))
    assert sel.count() == 2 and works.first()["work_id"] == "w1"


def test_notes_and_lint(spark, write, tmp_path):
    write("v/04_CANON/Ann Lee.md", "---\ntype: canon\nstatus: working\nlast_updated: 2024-01-01\n---\nSee [[Bo|b]], [[05_PROJECTS/Active/PRJ - Plan]] and [[Nowhere]].\n")
    write("v/05_PROJECTS/Active/PRJ - Plan.md", "---\ntype: project\nstatus: archived\n---\n- **Ann  Lee** — x\na\nb\nc\nd\n[[Ann Lee]]")
    notes = ar.read_notes(spark, str(tmp_path / "v"), str(tmp_path / "v"))
    got = {(r["check"], r["path"], r["detail"]) for r in pl.vault_lint(notes, "2024-05-01").collect()}
    assert ("broken_link", "04_CANON/Ann Lee.md", "Nowhere") in got and ("broken_link", "04_CANON/Ann Lee.md", "Bo") in got
    assert ("stub", "04_CANON/Ann Lee.md", "1") in got and ("stale", "04_CANON/Ann Lee.md", "121") in got
    assert ("status_mismatch", "05_PROJECTS/Active/PRJ - Plan.md", "archived in Active") in got
    assert not any(c == "orphan" for c, _, _ in got)
    assert [r["name"] for r in ar.bold_names(notes).collect()] == ["Ann Lee"]
    names = {r["key"]: r["display"] for r in ar.read_name_dictionary(notes, "PRJ - ").collect()}
    assert names == {"ann lee": "Ann Lee", "plan": "Plan"}


def test_pages_sink_keeps_order(spark, tmp_path):
    lines = spark.range(1000).select((F.col("id") % 3).cast("string").alias("k"), F.col("id").alias("o"), F.concat(F.lit("line "), "id").alias("line"))
    wr.write_pages(lines, str(tmp_path / "pages"), "k", ["o"])
    got = []
    for f in sorted((tmp_path / "pages" / "page=1").glob("part-*")):
        got += f.read_text().splitlines()
    assert got == [f"line {i}" for i in range(1, 1000, 3)]
