"""Callers' columns that are named as the operators' own working columns: none is lost, changed or in the way."""

import pytest
from hearthbook.llm import line_dedup, mixing, near_dedup, pieces, quality
from pyspark.sql import functions as F

OWN = ["_m", "_k", "_s", "_d", "_size", "_doc", "_gone", "_cut", "_lines", "_range", "_q_n_words", "_n", "ids", "round_trip", "least", "mark", "draws", "same"]


@pytest.fixture(scope="module")
def clashing(edges):
    return edges.select("*", *[F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in OWN])


def carried(out, without=()):
    rows = out.select("doc_id", *[c for c in OWN if c not in without]).collect()
    assert rows
    for r in rows:
        for c in OWN:
            if c not in without:
                assert r[c] == f"{c}:{'-' if r.doc_id is None else r.doc_id}", c
    return len(rows)


def test_near_copies(clashing, edges):
    out = near_dedup.drop_near_copies(clashing)
    assert out.columns == clashing.columns and carried(out) == near_dedup.drop_near_copies(edges).count()


def test_mixing(clashing):
    out = mixing.mixed_rows(clashing)
    assert out.columns == clashing.columns and carried(out)


def test_lines(clashing):
    out = line_dedup.drop_repeated_lines(clashing)
    assert sorted(out.columns) == sorted(clashing.columns) and carried(out, ["_lines"]) == clashing.count()
    assert set(out.select("_lines.*").columns) == {"n_lines", "n_removed", "n_runs"}


def test_lines_with_an_odd_key(clashing):
    named = clashing.drop("_k", "_m").withColumnsRenamed({"doc_id": "_k", "text": "_m"})
    out = line_dedup.drop_repeated_lines(named, "_k", "_m")
    plain = line_dedup.drop_repeated_lines(clashing)
    assert sorted(map(str, out.select("_k", "_m").collect())) == sorted(str(r).replace("doc_id", "_k").replace("text=", "_m=") for r in plain.select("doc_id", "text").collect())


def test_pieces(clashing, edges):
    out = pieces.encode(clashing, round_trip="round_trip")
    assert carried(out, ["ids", "round_trip"]) == clashing.count()
    plain = pieces.encode(edges, round_trip="round_trip")
    assert sorted(map(str, out.select("ids", "round_trip").collect())) == sorted(map(str, plain.select("ids", "round_trip").collect()))


def test_quality(clashing, edges):
    out = quality.quality_filter(clashing)
    assert out.columns == clashing.columns and out.count() == quality.quality_filter(edges).count()
