"""The recurrent model: gradients against differences, proper probabilities, base scores against brute force, held-out gain."""

import itertools
import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hearthbook.llm import gru, lm_scoring


def small(seed=1, vocab=12):
    counts = np.array([30.0, 50, *range(vocab - 2, 0, -1)])
    shape = gru.Shape(vocab, 3, 4, gru.class_edges(counts, 4))
    return shape, gru.fresh(shape, counts, seed).astype(np.float64)


def texts(seed, many, vocab=12, longest=40):
    rng = np.random.default_rng(seed)
    return [np.append(rng.integers(1, vocab, rng.integers(0, longest)), gru.END).astype(np.int32) for _ in range(many)]


def plain_score(shape, flat, ids):
    """One text alone, word by word, with every softmax written out."""
    w, hidden = gru.views(flat, shape), shape.hidden
    h, before, total = np.zeros(hidden), gru.END, 0.0
    for word in ids:
        x, g = w["E"][before] @ w["Wx"] + w["bx"], h @ w["U"]
        r = 1 / (1 + np.exp(-(x[:hidden] + g[:hidden])))
        z = 1 / (1 + np.exp(-(x[hidden:2 * hidden] + g[hidden:2 * hidden])))
        n = np.tanh(x[2 * hidden:] + r * (g[2 * hidden:] + w["bn"]))
        h = (1 - z) * n + z * h
        classes = np.exp(h @ w["Wc"] + w["bc"])
        words = np.zeros(shape.vocab)
        for c, (low, high) in enumerate(zip(shape.edges, shape.edges[1:])):
            inner = np.exp(w["Wo"][low:high] @ h + w["bo"][low:high])
            words[low:high] = classes[c] / classes.sum() * inner / inner.sum()
        assert abs(words.sum() - 1) < 1e-9
        total += np.log(words[word])
        before = word
    return total


def test_scores_carry_the_state_through_whole_texts():
    shape, flat = small()
    some = texts(2, 30) + texts(3, 2, longest=700) + [np.array([gru.END], np.int32)]
    got = gru.Net(flat, shape).score(some, width=5)
    assert np.allclose(got, [plain_score(shape, flat, t) for t in some], rtol=1e-4)


def test_gradients_equal_differences():
    shape, flat = small(4)
    lanes = gru.deal(texts(5, 6, longest=9), 4)
    window = next(gru.windows(lanes))
    h = np.random.default_rng(0).standard_normal((len(lanes.lengths), shape.hidden))
    grad = np.zeros_like(flat)
    gru.Net(flat, shape).gradient(h, window, gru.views(grad, shape))

    def loss(x):
        net = gru.Net(x, shape)
        states = net.states(h, window.inputs, *net.prepared())
        return -(net.log_probs(states.reshape(-1, shape.hidden), window.targets.ravel()) * window.valid.ravel()).sum() / window.valid.sum()

    for i in np.random.default_rng(1).choice(len(flat), 80, replace=False):
        up, down = flat.copy(), flat.copy()
        up[i] += 1e-2
        down[i] -= 1e-2
        assert abs((loss(up) - loss(down)) / 2e-2 - grad[i]) < 2e-3, i


def test_words_and_letters():
    words, sizes = lm_scoring.words_of(pa.array(["A b\x0bÉ  c", "", " \t\n", "x\x1cy z", "\nq\r"]))
    assert words.to_pylist() == ["a", "b", "É", "c", "x\x1cy z", "q"] and list(sizes) == [4, 0, 0, 1, 1]
    pairs, triples, starts = lm_scoring.byte_codes(pa.array(["zz", "ab", "c"])[1:])
    assert list(starts) == [0, 3] and [divmod(int(c), 257) for c in pairs] == [(256, 97), (97, 98), (98, 256), (256, 99), (99, 256)]
    assert list(triples) == [(a * 257 + b) % lm_scoring.CONTEXTS * 257 + c for a, b, c in [(256, 256, 97), (256, 97, 98), (97, 98, 256), (256, 256, 99), (256, 99, 256)]]
    known = lm_scoring.Lexicon([("ab", 2)], 1, 3, 2, 1, (np.array([0]), np.array([0.0])), 3, 1)
    known.codes = (np.concatenate([pairs, triples + lm_scoring.PAIRS]), np.ones(2 * len(pairs)))
    known.ready()
    # the letters of all words of one byte and the ends of longer ones are one distribution
    one = known.spelled(pa.array([bytes([i]) for i in range(1, 128)], pa.binary()))
    assert 0 < (10 ** one).sum() < 1


def brute_base(rows):
    split = lambda t: (t or "").encode().lower().split() + [None]
    held = lambda k: zlib.crc32(("" if k is None else str(k)).encode()) % 10 == 0
    counts = Counter(w for k, t in rows if not held(k) for w in split(t))
    total = sum(counts.values())
    floor = total + 0.1 * (len(counts) + 1)
    return sorted(((str(k), held(k), len(split(t)), sum(counts[w] > 0 for w in split(t)), total,
                    round(sum(math.log10((counts[w] + 0.1) / floor) for w in split(t)), 6)) for k, t in rows))


def shown(df):
    return sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in df.collect())


@pytest.mark.parametrize("head,vocab", [(131_072, 2048), (6, 5), (0, 2)])
def test_base_scores_equal_brute_force(spark, edges, edge_rows, head, vocab):
    got = lm_scoring.lm_scores(edges, head=head, vocab=vocab, rates=(0.01,)).cache()
    assert shown(got) == brute_base([r[:2] for r in edge_rows])
    assert all(math.isfinite(r.score) and r.score < 0 for r in got.collect())


def test_nothing_to_score_and_nothing_to_learn_from(spark, nothing):
    assert lm_scoring.lm_scores(nothing).count() == 0
    key = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 10 == 0)
    rows = [(key, "one two one"), (key, None)]
    assert shown(lm_scoring.lm_scores(spark.createDataFrame(rows, "doc_id long, text string"))) == brute_base(rows)


def test_held_out_texts_of_a_regular_language_gain(spark):
    rng = random.Random(9)
    chain = {i: [rng.randrange(60) for _ in range(3)] for i in range(60)}

    def text(n):
        at, out = rng.randrange(60), []
        for _ in range(n):
            out.append(f"w{at}")
            at = rng.choice(chain[at])
        return " ".join(out)

    rows = [(i, text(rng.randrange(20, 200))) for i in range(1500)]
    got = lm_scoring.lm_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).filter("held_out").toPandas()
    assert len(got) > 100 and got.score.sum() / got.n_tokens.sum() > got.base_score.sum() / got.n_tokens.sum() + 0.3


def fresh_memory(work):
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_windows_take_up_the_arrays_of_the_one_before():
    counts = np.array([400.0, 9000, *range(600, 0, -1)])
    shape = gru.Shape(len(counts), 8, 16, gru.class_edges(counts, 24))
    flat = gru.fresh(shape, counts)
    lanes = gru.deal(texts(6, 2000, vocab=len(counts), longest=80), 256)
    first, second = itertools.islice(gru.windows(lanes), 2)
    net, grad = gru.Net(flat, shape), gru.views(np.zeros_like(flat), shape)
    h = net.gradient(np.zeros((256, 16), np.float32), first, grad)
    layer = second.inputs.size * shape.hidden * flat.itemsize
    # with fresh arrays for every window a gradient took 22 layers of states, and probabilities 4
    assert fresh_memory(lambda: net.gradient(h, second, grad)) < 8 * layer
    states = net.states(h, second.inputs, *net.prepared()).reshape(-1, shape.hidden)
    assert fresh_memory(lambda: net.log_probs(states, second.targets.ravel())) < 2.5 * layer
    # nothing of an earlier window is left in what is found
    other = gru.views(np.zeros_like(flat), shape)
    gru.Net(flat, shape).gradient(h, second, other)
    net.gradient(h, second, grad)
    assert all(np.array_equal(grad[name], other[name]) for name in grad)
