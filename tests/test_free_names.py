"""Free names against a sequential rule: kept names first, then the lowest free numbers in order."""

import random

import pytest
from hearthbook.operators import ordering as oo
from pyspark.sql import functions as F


def split(name):
    at = name.rfind(".")
    return (name, "") if at <= 0 or at == len(name) - 1 else (name[:at], name[at:])


def sequential(rows, taken):
    used, out, wait = set(taken), {}, []
    for i, folder, name in sorted(rows, key=lambda r: r[0]):
        if name is None:
            out[i] = None
        elif (folder, name) in used:
            wait.append((i, folder, name))
        else:
            used.add((folder, name))
            out[i] = name
    for i, folder, name in wait:
        stem, ext = split(name)
        no = 1
        while (folder, f"{stem}_{no}{ext}") in used:
            no += 1
        out[i] = f"{stem}_{no}{ext}"
        used.add((folder, out[i]))
    return out


def names(spark, rows, taken, **more):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "id long, dir string, name string, no string, _j long")
    held = spark.createDataFrame(taken, "d string, n string") if taken is not None else None
    got = oo.unique_destinations(df, "dir", "name", [F.asc("id")], F.shiftright("id", 3), taken=held, **more)
    assert got.columns == [*df.columns, "dest_name"]
    return {r.id: r.dest_name for r in got.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_names_equal_the_sequential_rule(spark, seed):
    rng = random.Random(seed)
    some = ["a.jpg", "a_1.jpg", "a_2.jpg", "a_01.jpg", "b", "b_3", ".hidden", ".hidden_1", "a.b.c", None, "a_1_1.jpg"]
    rows = [(i, rng.choice(["d", "e", None]), rng.choice(some)) for i in range(300)]
    taken = [("d", f"a_{n}.jpg") for n in rng.sample(range(120), 60)] + [("d", "b"), (None, "a.jpg"), (None, "a.jpg"), ("e", "b_99999999999999999999"), ("zz", "a_1.jpg")]
    assert names(spark, rows, taken) == sequential(rows, taken)
    assert names(spark, rows, None) == sequential(rows, [])


def test_a_thousand_taken_numbers_take_no_rounds(spark, monkeypatch):
    import hearthbook.session as session

    stored = []
    plain = session.materialise
    monkeypatch.setattr(session, "materialise", lambda df, name="stage": stored.append(name) or plain(df, name))
    rows = [(i, "d", "scan.pdf") for i in range(50)]
    few = [("d", "scan.pdf"), ("d", "scan_2.pdf")]
    many = [("d", "scan.pdf")] + [("d", f"scan_{n}.pdf") for n in range(1, 1101) if n % 100]
    assert names(spark, rows, few) == sequential(rows, few)
    after_few = len(stored)
    assert names(spark, rows, many) == sequential(rows, many)
    assert len(stored) == 2 * after_few


def test_extensions_that_read_like_numbers_are_settled_too(spark):
    rows = [(i, "d", n) for i, n in enumerate(["x._1", "x._1", "x_1.", "x_1.", "x_1."])]
    got = names(spark, rows, None)
    assert len(set(got.values())) == 5
    with pytest.raises(ValueError):
        names(spark, rows, None, mark="0")
