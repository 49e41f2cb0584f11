"""The index of fixed pieces: what it finds in a text, and that it never hides a match."""

import random
import re

from hearthbook.functions import prefilter as pf
from pyspark.sql import functions as F


def test_longest_piece_of_each_place(spark):
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("ab.é ") for _ in range(rng.randrange(1, 6))) for _ in range(60)} | {"a\nb", "\\d", "[x]", "$^", "abab"})
    texts = ["".join(rng.choice("ab.é \n\\d[]x$^") for _ in range(rng.randrange(80))) for _ in range(80)]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(pf.occurring(F.col("t"), words)).collect()]
    for t, found in zip(texts, got):
        want = {max((w for w in words if t.startswith(w, i)), key=len, default=None) for i in range(len(t))} - {None}
        assert set(found) == want


def test_index_is_a_necessary_condition(spark):
    patterns = [r"(CNN|NBC)", r"(?i)follow(er)?s?", r"buy\s+now", r"buyer", r"@\w{3,}", r"\d+ likes", r"(?i)Ünique"]
    rng = random.Random(3)
    bits = ["CNN", "cnn", "Follow", "FOLLOWERS", "buy now", "buyer", "buy", "@abc", "12 likes", "ünique", " ", "x", "\n"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(6))) for _ in range(200)]
    index = pf.PatternIndex(patterns)
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", index.numbers(F.col("t")).alias("own"), index.numbers(F.lower("t")).alias("low"))
    needs = [index.need(p, F.col("own"), F.col("low")) for p in patterns]
    rows = df.select("t", *[(F.lit(True) if n is None else n).alias(f"n{i}") for i, n in enumerate(needs)]).collect()
    sure = 0
    for r in rows:
        for i, p in enumerate(patterns):
            assert r[f"n{i}"] or not re.search(p, r.t)
            sure += not r[f"n{i}"]
    assert sure > len(texts)


def test_sets_of_words_are_found_on_batches_as_one_by_one(spark):
    import random
    from hearthbook.functions.prefilter import held, holds_any
    from hearthbook.operators.classify import keyword_class
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("ab.é $[\\|*\n😀K") for _ in range(n))
    sets = [[text(rng.randrange(1, 4)) for _ in range(rng.randrange(4))] for _ in range(35)]
    texts = [text(rng.randrange(30)) for _ in range(200)] + ["", None]
    df = spark.createDataFrame([(t,) for t in texts], "c string")
    for t, found in df.select("c", held(F.col("c"), sets)).collect():
        assert sorted(map(int, found)) == [i for i, ws in enumerate(sets) if any(w in (t or "") for w in ws)]
    assert [r[0] for r in df.filter("c is not null").select(holds_any(F.col("c"), ["k.", "B["], fold=True)).collect()] == [
        "K." in t or "b[" in t for t in texts if t is not None]
    rules = {"x": (1.0, ["ab", "ab", "$"]), "y": (1.5, ["é", "$"])}
    classed = keyword_class(spark.createDataFrame([("AB $",), ("É",), ("É$ab",), (None,)], "c string"), F.col("c"), F.lit("-"), rules)
    assert [(r.category, r.score) for r in classed.collect()] == [("x", 2.0), ("-", 1.5), ("y", 3.0), ("-", 0.0)]
    assert "exists(" not in classed._jdf.queryExecution().optimizedPlan().toString() and "Contains" not in classed._jdf.queryExecution().optimizedPlan().toString()
