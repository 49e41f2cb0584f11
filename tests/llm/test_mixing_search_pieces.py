"""Mixing, top-k search, SentencePiece and the pipeline."""

import random

import numpy as np
import pytest
import sentencepiece
from conftest import text_of
from pyspark.sql import functions as F

from hearthbook.llm import mixing, pieces, topk
from hearthbook.llm.common import components, running


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        free = sum(weight[s] for s in names if s not in capped)
        target = {s: 3.0 * sizes[s] if s in capped else weight[s] * left / free for s in names}
        over = {s for s in names if s not in capped and target[s] > 3 * sizes[s]}
        if not over:
            return target
        capped |= over


def corpus(spark, n=300):
    rng = random.Random(8)
    sources = ["hot"] * 6 + ["b", "c", "é", "zz", None, "tiny"]
    rows = [(i, text_of(rng, rng.randrange(200)), rng.choice(sources)) for i in range(n)]
    rows += [(n, "a b c", "one"), (n + 1, "", "blank"), (n + 2, None, "blank"), (n + 3, text_of(rng, 5000), "giant")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_mix_meets_its_targets_and_is_repeatable(spark):
    rows, docs = corpus(spark)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split(" ") if t else [])
    want = plain_targets(sizes)
    got = mixing.mix(docs, block_words=500, shards=7).collect()
    again = mixing.mix(docs.repartition(5), block_words=500, shards=7).collect()
    assert {(r.doc_id, r.taken, str(sorted(r.draws))) for r in got} == {(r.doc_id, r.taken, str(sorted(r.draws))) for r in again}
    taken, shards = {}, {}
    for r in got:
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert r.taken <= 3 * r.size and r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        for d in r.draws:
            shards[d.shard] = shards.get(d.shard, 0) + d.words
    for s, t in taken.items():
        assert abs(t - want[s]) <= 1
    assert len(shards) == 7


def test_splitting_tree_keeps_quotas():
    quotas = np.array([5, 0, 1000, 37])
    out = mixing.split_quotas(quotas, 6, 1, 0)
    assert out.sum(0).tolist() == quotas.tolist() and out.sum(1).max() - out.sum(1).min() <= 1 and (out >= 0).all()


def test_mixed_rows_cut_only_the_end_of_a_source(spark, edges, nothing):
    rows, docs = corpus(spark, 120)
    texts = {r[0]: r[1] for r in rows}
    out = mixing.mixed_rows(docs, block_words=500)
    assert out.columns == docs.columns
    cut = [r for r in out.collect() if r.text != texts[r.doc_id]]
    assert all(texts[r.doc_id].startswith(r.text) for r in cut)
    assert len({r.source for r in cut}) == len(cut)
    got = mixing.mix(edges)
    assert got.agg(F.sum("copies")).first()[0] == 16
    assert mixing.mix(nothing).count() == 0 and mixing.mixed_rows(nothing).count() == 0
    assert mixing.mixed_rows(edges).columns == edges.columns


def test_running_numbers_and_totals(spark):
    rng = random.Random(9)
    values = [rng.randrange(1000) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v long").repartition(7)
    got = running(df, [F.col("v").asc()], {"upto": "v"}, "no").orderBy("no").collect()
    assert [r.v for r in got] == sorted(values) and [r.no for r in got] == list(range(500))
    assert got[-1].upto == sum(values)


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 102), (101, 103), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 104)}}


def test_search_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    vectors = np.round(rng.normal(size=(300, 12)), 2)
    vectors[50:80] = vectors[0]  # ties
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [(300, None), (301, []), (302, [float("nan")] * 12), (303, [None] + [1.0] * 11), (None, [1.0] * 12), (304, [1.0] * 3), (10, rows[10][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("x"))
    got = topk.top_k(df, df.filter("vec_id % 100 = 0"), block_rows=64, query_rows=2)
    whole = {i: np.floor(v * 1024) for i, v in enumerate(vectors)}
    listed = [(i, whole[i]) for i in range(300)] + [(10, whole[10])]
    found = {}
    for r in got.orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for q in (0, 100, 200):
        best = sorted((-int(whole[q] @ v), i) for i, v in listed if i != q)[:10]
        assert found[q] == [(n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert set(found) == {0, 100, 200}
    assert topk.top_k(df.limit(0), df).count() == 0 and topk.top_k(df, df.limit(0)).count() == 0


def test_search_of_large_and_uneven_vectors(spark):
    rng = random.Random(12)
    rows = [(i, [rng.uniform(-2**19, 2**19) for _ in range(4)]) for i in range(250)]  # sums beyond 2^53
    rows += [(i, [rng.random() for _ in range(rng.choice([0, 0, 3, 6]))]) for i in range(250, 330)]
    rows += [(400, []), (500, [0.0, -1.0]), (601, [0.0, 0.0, 1.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {i: [int(np.floor(1024 * x)) for x in v] for i, v in rows}
    found = {}
    for r in topk.top_k(df, df.filter("vec_id % 100 = 0"), block_rows=64).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(found) == {0, 100, 200, 300, 400, 500}
    for q in found:
        best = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:10]
        assert found[q] == [(n + 1, i, -s) for n, (s, i) in enumerate(best)]
    far = np.array([[2.0**40, 1 - 2.0**40], [2.0**40, -(2.0**40)], [0, 0]])
    (asked, held, kind), = topk.exact_kinds(far[:1], far[1:2] * -1)
    assert kind is object and asked.all() and held.all()
    got = topk.search_block(topk.as_kind(np.array([[2.0**40, 2.0**40]]), object), np.array([9]), topk.as_kind(far, object), np.arange(3), 2)
    assert list(got["vec_id"]) == [0, 1] and list(got["score"]) == [2**40, 0]


def test_pieces_equal_the_library():
    v = pieces.vocabulary(pieces.load_model(pieces.MODEL))
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rng = random.Random(10)
    texts = ["", " ", "x" * 3000, "ab" * 2000, "\x00a\x00", "<s> <0x0A> </s>", "   lead", "tail   ", "▁", "a▁b", "\r\n\t"]
    texts += ["".join(rng.choice("ab c▁\n\t éßñ漢😀thein  ") for _ in range(rng.randrange(60))) for _ in range(400)]
    texts += [text_of(rng, 200, True) for _ in range(20)]
    got = pieces.encode_batch([*texts, None], v, pieces.Known()).to_pylist()
    assert got[:-1] == lib.encode(texts) and got[-1] is None
    assert [pieces.decode_ids(x, v) for x in got[:-1]] == lib.decode(got[:-1])


def test_pieces_of_edges(edges, edge_rows, nothing):
    coded = pieces.encode(edges)
    assert coded.columns == [*edges.columns, "ids"]
    back = pieces.decode(coded).collect()
    for r in back:
        if r.text is None:
            assert r.ids is None and r.decoded is None
        else:
            assert r.decoded == r.text.replace("▁", " ")
    assert len(back) == len(edge_rows) and pieces.decode(pieces.encode(nothing)).count() == 0


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(11)
    def clean(n):
        return "\n".join(" ".join(f"w{rng.randrange(3000)}" for _ in range(25)) + "." for _ in range(n))
    texts = [clean(4) for _ in range(30)]
    near = texts[0].split(" ")
    near[10] = "changed"
    junk = ["###$$$ " * 40, "SHOUT!! AGAIN!! " * 30, "", "two words"]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate([*texts, texts[1], " ".join(near), *junk])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = []
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        left.append({r.doc_id for r in docs.collect()})
    assert left[0] == set(range(32)) and left[1] == set(range(30)) | {31} - {30} or left[1] >= set(range(30))
    assert set(range(30)) <= left[2] and 30 not in left[2]
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.filter("not round_trip").count() == 0 and {r.doc_id for r in out.collect()} <= left[3]


def test_queries_equal_their_sql(spark):
    import os
    import sys

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from check_queries import compare, connect

    from hearthbook.catalogue.base import Query
    from hearthbook.llm import registry

    found, sql = registry()
    con = connect("/root/testdata/sf0.001")
    for name, text in sql.items():
        said, ok = compare(spark, con, "/root/testdata/sf0.001", Query(found[name], text, ""))
        assert ok, (name, said)
