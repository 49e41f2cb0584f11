"""Dictionary lookup against brute force: lengths, overlaps of stretches, hot anchors, both joins."""

import random

import pytest
from hearthbook.operators import dictionary
from pyspark.sql import functions as F


def pairs(rows, keys):
    return sorted({(i, k) for i, t in rows if t is not None for k in keys if k and k in t})


@pytest.mark.parametrize("broadcast_keys", [200_000, 0])
@pytest.mark.parametrize("stretch", [4096, 16])
def test_contained_equals_brute_force(spark, monkeypatch, broadcast_keys, stretch):
    monkeypatch.setattr(dictionary, "STRETCH", stretch)
    rng = random.Random(stretch)
    letters = "aab \n.é漢😀"
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    rows = [(i, text(rng.randrange(200))) for i in range(60)] + [(60, None), (61, ""), (62, text(9000)), (63, "tion " * 4000 + "stations end"), (1, "twice aab")]
    keys = [text(n) for n in (1, 2, 3, 4, 5, 6, 9, 12, 30) for _ in range(8)] + ["", None, "tion", "tions", "stations end", "ationtion", rows[62][1][4000:4200], rows[62][1][-50:]]
    docs = spark.createDataFrame(rows, "id long, text string")
    found = dictionary.contained(docs, "id", F.col("text"), spark.createDataFrame([(k,) for k in keys], "key string"), broadcast_keys)
    assert sorted(map(tuple, found.collect())) == pairs(rows, keys)


def test_nothing_to_find(spark):
    docs, keys = spark.createDataFrame([(1, "some text")], "id long, text string"), spark.createDataFrame([("text",)], "key string")
    assert dictionary.contained(docs, "id", F.col("text"), keys.limit(0)).count() == 0
    assert dictionary.contained(docs.limit(0), "id", F.col("text"), keys).count() == 0


def test_texts_are_read_once_and_never_shuffled(spark):
    docs = spark.createDataFrame([(i, f"text number {i}") for i in range(20)], "id long, text string")
    keys = spark.createDataFrame([("number",), ("er 1",)], "key string")
    plan = dictionary.contained(docs, "id", F.col("text"), keys)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 1 and "part#" not in "".join(x for x in plan.split("\n") if "Exchange hash" in x)


def test_several_dictionaries_in_one_pass(spark):
    rows = [("a/x", "Ann Lee met Bob", "harbour works"), ("b", None, "ann lee"), ("c", "nothing", ""), ("d", "bob and Harbour Works and harbour", "bob")]
    df = spark.createDataFrame(rows, "path string, body string, folder string")
    people = spark.createDataFrame([("ann lee", "Ann Lee"), ("bob", "Bob"), ("bo", "Bo")], "key string, display string")
    places = spark.createDataFrame([("harbour", "Harbour"), ("Harbour Works", "Harbour Works"), ("and", "And")], "key string, display string")
    got = dictionary.match_dictionaries(df, "path", {"b": F.col("body"), "f": F.col("folder")}, {
        "who": ("b", people, 1), "whose": ("f", people, 3), "where": ("b", places, 4), "there": ("f", places, 1)})
    assert sorted(map(tuple, got.select("path", "who", "whose", "where", "there").collect()), key=str) == [
        ("a/x", "Ann Lee", None, None, "Harbour Works"), ("b", None, "Ann Lee", None, None), ("d", "Bob", "Bob", "Harbour Works", None)]


@pytest.mark.parametrize("n", [3, 16, 300])
def test_short_dictionaries_carry_no_text_and_equal_brute_force(spark, n):
    rng = random.Random(n)
    text = lambda k: "".join(rng.choice("aab \n.-é漢😀[") for _ in range(k))
    rows = [(i, text(rng.randrange(300))) for i in range(50)] + [(50, None), (51, ""), (1, "aab aabb")]
    keys = list(dict.fromkeys(text(rng.randrange(1, 9)) for _ in range(2 * n)))[:n]
    docs = spark.createDataFrame(rows, "id long, text string")
    found = dictionary.contained(docs, "id", F.col("text"), spark.createDataFrame([(k,) for k in keys], "key string"))
    assert "part#" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, found.collect())) == pairs(rows, keys)
