"""Cases that a review of the fourth round found."""

import duckdb

from hearthbook.catalogue import load
from hearthbook.sources import html as h
from hearthbook.streaming import flows

# A heading with all five references that page writers use, cut at every place.
HEADING = "&quot;Tom &amp; Ann&quot; &lt;b&gt; it&#x27;s"


def test_headings_cut_inside_a_reference_read_as_in_sql(spark, tmp_path):
    heads = [HEADING[:n].strip() for n in range(1, len(HEADING) + 1)]
    rows = [(i, f"https://x.example/{i}", f"<html><body><article><h1>{t}</h1><p>a &quot b</p></article></body></html>") for i, t in enumerate(heads)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    query = load()["html_titles"]
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    got = sorted(tuple(r) for r in query.run(spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(query.sql).fetchall()) and len(got) == len(HEADING)


def test_only_closed_references_are_read_where_asked():
    text = "&quot &quot; &quota; &nosuch; &copy=1 &#39 &#39; &#x2 &amp &amp;lt; & &&"
    assert h.parse(h.closed_references(text)).text() == '&quot " &quota; &nosuch; &copy=1 &#39 \' &#x2 & &lt; & &&'
    assert h.parse("&quot").text() == '"'


def batches(query):
    query.awaitTermination()
    return sum(p["numInputRows"] > 0 for p in query.recentProgress)


def test_many_small_files_take_one_batch_and_large_ones_several(spark, tmp_path):
    texts = {f"t{i}": f"text {i}\n" for i in range(1500)} | {"blank": "", "wide é": "\ufeffzwei\r\nZeilen ß"}
    for name, text in texts.items():
        folder = tmp_path / "in" / f"m{len(name)}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{name}.txt").write_bytes(text.encode())
    (tmp_path / "in" / "m3" / "note.md").write_text("no text file")
    inbox, out, log = (str(tmp_path / x) for x in ("in", "out", "log"))
    with flows.quick_look_up(spark, inbox):
        assert batches(flows.append_stream(flows.text_stream(spark, inbox), out, log)) == 1
    got = {r.stem: r.text for r in spark.read.parquet(out).collect()}
    assert got == {n.replace(" ", "%20"): t for n, t in texts.items() if t}
    # as Spark's own reader of whole texts has them, which leaves out empty files as well
    whole = spark.read.option("pathGlobFilter", "*.txt").option("recursiveFileLookup", True).text(inbox, wholetext=True)
    assert sorted(r.value for r in whole.collect()) == sorted(got.values())
    folder = f"{inbox}/long"
    for i in range(4):
        (tmp_path / "in" / "long").mkdir(exist_ok=True)
        (tmp_path / "in" / "long" / f"{i}.txt").write_text("x" * 3000)
    assert batches(flows.append_stream(flows.text_stream(spark, folder, bytes_per_batch=7000), out + "2", log + "2")) == 2
    assert batches(flows.append_stream(flows.text_stream(spark, folder, files_per_batch=1), out + "3", log + "3")) == 4
    assert [spark.read.parquet(out + n).where("length(text) = 3000").count() for n in ("2", "3")] == [4, 4]


def test_look_up_keeps_nothing_and_settings_come_back(spark):
    names = ["spark.sql.files.openCostInBytes", "spark.sql.hive.filesourcePartitionFileCacheSize"]
    before = [spark.conf.get(n) for n in names]
    with flows.quick_look_up(spark, "/tmp/x"):
        assert [spark.conf.get(n) for n in names] == ["256k", "0"] != before
    assert [spark.conf.get(n) for n in names] == before
