"""Files written by tasks under their own names."""

from hearthbook.functions import text as ft
from hearthbook.sinks import writers as wr
from pyspark.sql import functions as F


def test_named_files_hold_text_or_bytes(spark, tmp_path):
    rows = [("a b.txt", "é\nx"), ("deep/er/c.md", ""), (None, "lost"), ("n.txt", None), ("a b.txt", "é\nx")]
    out = str(tmp_path / "x")
    assert wr.write_named(spark.createDataFrame(rows, "name string, text string"), out) == 4
    assert (tmp_path / "x" / "a b.txt").read_text(encoding="utf-8") == "é\nx"
    assert (tmp_path / "x" / "deep" / "er" / "c.md").read_bytes() == b"" == (tmp_path / "x" / "n.txt").read_bytes()
    assert sorted(p.name for p in (tmp_path / "x").rglob("*") if p.is_file()) == ["a b.txt", "c.md", "n.txt"]
    raw = spark.createDataFrame([("p.png", bytearray(b"\x89PNG\xff"))], "f string, b binary")
    assert wr.write_named(raw, f"file://{tmp_path}/y", "f", "b") == 1
    assert (tmp_path / "y" / "p.png").read_bytes() == b"\x89PNG\xff"
    assert wr.write_named(raw.limit(0), out, "f", "b") == 0


def test_quoted_lines_and_the_blanks_behind_them_go(spark):
    texts = {
        "a\n> q\n\n\nb": "a\nb", "> q": "", ">q\n \n  > r\nx\n>": "x", "a\n\n> q\n\t\n": "a", "a > b\n c": "a > b\n c", "": "",
        "keep\nOn Monday, Ann wrote:\nold": "keep", "x\n" * 20000 + "> y\n" * 20000 + "end": "x\n" * 20000 + "end",
    }
    got = {r.t: r.b for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", ft.strip_replies(F.col("t")).alias("b")).collect()}
    assert got == texts
