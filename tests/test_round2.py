"""Cases that once went wrong: flags in patterns, anchored leak rules, folder streams, taken names."""

import os
import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from hearthbook.functions.names import title_case
from hearthbook.functions.prefilter import pieces
from hearthbook.functions.text import hits, occurs
from hearthbook.operators import lint, ordering as oo
from hearthbook.streaming import flows


@pytest.mark.parametrize("pattern", [r"(?i:secret)\d", r"(?im)^secret\d", r"(?mi)secret\d", r"x*(?:a|(?i:secret))\d", r"(?ix) secret \d"])
def test_prefilter_knows_all_ways_to_ignore_case(spark, pattern):
    row = spark.createDataFrame([("SECRET1",)], "t string").select(occurs(F.col("t"), pattern).alias("o"), hits(F.col("t"), pattern).alias("n")).first()
    assert row.o and row.n == 1


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["abc", "(?i:De)", "(?:fg|hi)", r"\d", "x?", "(?i:é)", "[kl]"]), min_size=1, max_size=4), st.text("abcdefghiDEékl1x", max_size=12))
def test_pieces_never_hide_a_match(parts, text):
    import re

    pattern = "".join(parts)
    found, folded = pieces(pattern)
    if re.search(pattern, text) and found:
        assert any(p in (text.lower() if folded else text) for p in found)


def test_leak_rules_see_one_line(spark):
    texts = spark.createDataFrame([("a.md", "a\nsecret one\nz"), ("b.txt", "secret one"), ("c.md", "secret ok")], "path string, body string")
    rules = [("^secret", "x"), ("secret one$", "y"), ("(?i)SECRET", "z", "ok$")]
    got = {(r.category, r.path, r.line_no) for r in lint.leak_report(texts, rules, only=r"\.md$").collect()}
    assert got == {("x", "a.md", 2), ("y", "a.md", 2), ("z", "a.md", 2), ("x", "c.md", 1)}
    assert lint.leak_report(texts, rules, skip=r"\.md$").count() == 3


def test_a_table_in_a_folder_streams_whole(spark, tmp_path):
    spark.range(1000).repartition(5).write.parquet(f"{tmp_path}/t.parquet")
    rows = flows.table_stream(spark, str(tmp_path), "t.parquet", spark.range(1).schema, files_per_batch=2)
    flows.append_stream(rows, f"{tmp_path}/out", f"{tmp_path}/log").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").distinct().count() == 1000


def test_names_are_free(spark):
    rng = random.Random(1)
    names = ["a.jpg", "a.jpg", "a_1.jpg", "a_1.jpg", "a_1_1.jpg", "b", "b", "b_1"]
    names += [rng.choice(["c", "c_1", "c_2", "c_1_1", "c_2_1"]) + ".txt" for _ in range(40)]
    rows = [(i, "d", n) for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, "id long, dir string, name string")
    taken = spark.createDataFrame([("d", "b"), ("d", "c_3.txt"), ("e", "a.jpg")], "dir string, name string")
    got = {r.id: r.dest_name for r in oo.unique_destinations(df, "dir", "name", [F.asc("id")], F.shiftright("id", 2), taken=taken).collect()}
    assert len(got) == len(rows) and len(set(got.values())) == len(rows)
    assert not set(got.values()) & {"b", "c_3.txt"} and got[0] == "a.jpg" and got[2] == "a_1.jpg"
    firsts = {}
    for i, _, n in rows:
        firsts.setdefault(n, i)
    assert all(got[i] == n for n, i in firsts.items() if n not in ("b", "c_3.txt"))


def test_title_case(spark):
    df = spark.createDataFrame([("jean-luc o'hara",), ("ÉMILE du 3rd",), ("",)], "c string")
    assert [r[0] for r in df.select(title_case(F.col("c"))).collect()] == ["Jean-Luc O'Hara", "Émile Du 3Rd", ""]


def test_workers_find_the_package_from_any_folder(tmp_path):
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (f"import sys; sys.path.insert(0, {root!r})\n"
            "from hearthbook.session import local_session\nfrom hearthbook.catalogue import load\n"
            "print('rows', load()['press_links'].run(local_session('away', 2), '/root/testdata/sf0.001').count())")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows" in done.stdout, done.stderr[-2000:]
