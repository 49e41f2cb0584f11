"""Line runs, byte strings and near copies, against brute force."""

import hashlib
import itertools
import random

import numpy as np
from conftest import text_of

from hearthbook.llm import line_dedup, near_dedup, suffix_dedup


def order(rows):
    """Null keys first, then keys; texts of one key stand as the operators take them: given by the caller."""
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


def plain_lines(texts, least):
    """Lines left of texts in order: every run with enough words is compared with every earlier one."""
    seen, out = set(), []
    for text in texts:
        lines = text.split("\n")
        counts = [len(x.encode().split()) for x in lines]
        gone = [False] * len(lines)
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                if sum(counts[a:b + 1]) >= least:
                    run = tuple(lines[a:b + 1])
                    if run in seen:
                        gone[a:b + 1] = [True] * (b + 1 - a)
                    seen.add(run)
        out.append("\n".join(x for x, g in zip(lines, gone) if not g))
    return out


def test_repeated_line_runs(spark):
    rng = random.Random(1)
    pool = [text_of(rng, n) for n in (0, 1, 2, 2, 3, 4, 5, 9)]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randrange(14))) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for least in (1, 6, 15):
        got = {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(docs, min_words=least).collect()}
        assert [got[i] for i in range(len(texts))] == plain_lines(texts, least), least


def test_line_dedup_of_edges(edges, nothing):
    out = line_dedup.drop_repeated_lines(edges)
    assert out.columns == [*edges.columns, "_lines"]
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, []).append(r)
    whole = {r.doc_id: r.text for r in edges.collect()}
    assert {r.text for r in got[None]} == {whole[2], None}  # null keys come first and keep their text
    assert all(len(set(r.text for r in got[k])) == 1 for k in (1, 2))
    assert len(got[1][0].text) < 40 and got[1] == [got[1][0]] * 2 and got[6][0].text == whole[6]
    assert got[7][0]._lines.n_runs == 1 and got[3][0].text == "" and got[5][0].text == " \n\t "
    assert line_dedup.drop_repeated_lines(nothing).count() == 0


def plain_bytes(texts, length):
    seen, out = set(), []
    for raw in texts:
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            w = raw[i:i + length]
            if w in seen:
                gone[i:i + length] = b"\1" * length
            seen.add(w)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        left = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((len(raw), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return out


def mutated(rng):
    pool = [text_of(rng, 40) for _ in range(4)]
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(5)):
            p = rng.choice(pool)
            a = rng.randrange(len(p))
            parts.append(p[a:a + rng.randrange(250)])
            if rng.random() < 0.5:
                parts.append(text_of(rng, rng.randrange(6)))
        texts.append("".join(parts))
    return [*texts, "ab" * 300, "ab" * 200, "a" * 500, texts[3], texts[3], ""]


def test_repeated_bytes(spark):
    rng = random.Random(2)
    texts = mutated(rng)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = plain_bytes([t.encode() for t in texts], 100)
    for crowd in (100_000, 2):
        got = suffix_dedup.drop_repeated_bytes(docs, crowd=crowd).collect()
        found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got}
        assert [found[i] for i in range(len(texts))] == want, crowd


def test_collection_rounds_equal_plain_classes():
    rng = np.random.default_rng(0)
    count, width, length = 60, 24, 10
    grid = rng.integers(97, 99, (count, width)).astype(np.uint8)
    grid[10:40] = grid[rng.integers(0, 5, 30)]
    grid[np.arange(20, 40), rng.integers(0, width, 20)] = 120
    low, high = rng.integers(0, 6, count), rng.integers(18, width + 1, count)
    group, age = rng.integers(0, 3, count), rng.permutation(count)
    marks = suffix_dedup.sorted_rounds(lambda c: grid[:, c], count, group, age, low, high, width, length)
    for c in range(width - length + 1):
        seen = {}
        for i in np.argsort(age):
            inside = low[i] <= c and c + length <= high[i]
            key = (group[i], grid[i, c:c + length].tobytes())
            assert marks[i, c] == (inside and key in seen), (i, c)
            if inside:
                seen[key] = i


def test_repeated_bytes_of_edges(edges, nothing):
    got = suffix_dedup.drop_repeated_bytes(edges).collect()
    assert len(got) == 16 and suffix_dedup.drop_repeated_bytes(nothing).count() == 0
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.n_bytes, r.n_removed, r.n_spans))
    assert sorted(by[None]) == [(0, 0, 0), (by[2][0][0], 0, 0)]  # null keys come first
    assert by[1] == [(by[2][0][0],) * 2 + (1,)] * 2 and by[6][0][1] == 0 and by[7][0][1] == by[7][0][0]
    assert by[10][0][1:] == (4999, 1) and by[3] == by[4] == [(0, 0, 0)]


def jaccard_links(texts):
    def grams(t):
        w = t.encode().split()
        return {(tuple(w[i:i + 5])) for i in range(max(1, len(w) - 4))} if w else set()
    sets = [grams(t) for t in texts]
    return {(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if sets[a] and sets[b]
            and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}


def test_near_copies_against_all_pairs(spark):
    rng = random.Random(6)
    texts = []
    for _ in range(25):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([6, 40, 200]))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(12)):
            copy = list(base)
            for _ in range(rng.randrange(1 + len(base) // 45)):
                copy[rng.randrange(len(copy))] = f"n{rng.randrange(9999)}"
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in sorted(jaccard_links(texts)):
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r["class"] for r in near_dedup.near_classes(docs).collect()}
    assert got == {i: root(i) for i in range(len(texts))}
    kept = near_dedup.drop_near_copies(docs)
    assert {r.doc_id for r in kept.collect()} == set(got.values()) and kept.columns == docs.columns


def test_chain_is_the_longest_common_subsequence():
    rng = random.Random(7)
    for _ in range(300):
        a, b = rng.sample(range(30), 20), rng.sample(range(30), 20)
        best = [[0] * 21 for _ in range(21)]
        for i, j in itertools.product(range(20), range(20)):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        n = best[20][20]
        assert near_dedup.chain(np.array(a), np.array(b), 0.0) == n
        assert near_dedup.near_copies(np.array(a), np.array(b), 0.3) == (n >= 0.3 * (40 - n) - 1e-9)


def test_labels_make_windows_different():
    words = near_dedup.word_hashes("a b a b a b a b a b a b")
    e = near_dedup.windows(words)
    assert len(set(e.tolist())) == len(e) == 8


def test_near_copies_of_edges(edges, nothing):
    got = near_dedup.near_classes(edges).collect()
    assert len(got) == 16 and near_dedup.near_classes(nothing).count() == 0
    classes = {}
    for r in got:
        classes.setdefault(r.doc_id, set()).add(r["class"])
    assert classes[1] == classes[2] == {None} and classes[7] == {6}
    assert classes[3] == {3} and classes[4] == {4} and classes[5] == {5}
    kept = near_dedup.drop_near_copies(edges)
    assert kept.columns == edges.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    assert 1 not in ids and 2 not in ids and 7 not in ids and ids.count(9) == 2 and ids.count(None) == 2


def plain_classes(texts):
    least = list(range(len(texts)))
    for a, b in sorted(jaccard_links(texts)):
        low, high = sorted((least[a], least[b]))
        least = [low if x == high else x for x in least]
    return least


def variant(rng, base, cuts):
    out = list(base)
    for at in cuts:
        out[at] = f"v{rng.randrange(10 ** 9)}"
    return " ".join(out)


def test_a_star_of_variants_is_one_class(spark):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(300)]
    texts = [variant(rng, base, [i + rng.randrange(60) for i in (0, 75, 150, 225)]) for _ in range(500)]
    texts.insert(250, " ".join(base))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = plain_classes(texts)
    assert set(want) == {0}
    assert {r["class"] for r in near_dedup.near_classes(docs).collect()} == {0}


def test_near_copies_under_hot_boilerplate(spark):
    rng = random.Random(9)
    hot = [f"h{i}" for i in range(80)]
    texts = []
    for n in range(60):
        own = [f"o{n}_{i}" for i in range(rng.choice([18, 24, 40]))]
        texts.append(" ".join(hot + own))
        if n % 4 == 0:
            texts.append(variant(rng, hot + own, [90]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r["class"] for r in near_dedup.near_classes(docs).collect()}
    assert [got[i] for i in range(len(texts))] == plain_classes(texts)


def test_prefix_pairs_hold_all_near_copies(spark):
    rng = random.Random(10)
    base = [f"w{i}" for i in range(100)]
    texts = [variant(rng, base[:rng.choice([60, 80, 100])], rng.sample(range(60), rng.randrange(4))) for _ in range(80)]
    entries = [(near_dedup.windows(near_dedup.word_hashes(t)) >> np.uint64(32)).astype(np.uint32) for t in texts]
    rows = [(i, i // 3, bytearray(e.tobytes())) for i, e in enumerate(entries)]
    got = near_dedup.prefix_pairs(spark.createDataFrame(rows, "rid long, part long, entries binary"), 0.8)
    got = {(r.a, r.b) for r in got.collect()}
    links = {(a, b) for a, b in jaccard_links(texts) if a // 3 != b // 3}
    assert links and links <= got and all(a // 3 != b // 3 for a, b in got)
