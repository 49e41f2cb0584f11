"""Conversation trie and source audit against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from hearthbook.llm import conversation_trie, source_audit
from hearthbook.llm.queries_corpus import grafted


def brute_trie(rows, graft=True):
    seqs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            seqs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    seqs = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in seqs.items()}
    if graft:
        h = {c: zlib.crc32(str(c).encode()) % 4 for c in seqs}
        base = {c: c - (abs(c) % 20) * (1 if c >= 0 else -1) for c in seqs}
        seqs = {c: seqs.get(base[c], [])[:h[c]] + v[h[c]:] for c, v in seqs.items()}
    nodes = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            nodes[tuple(s[:d])].append(c)
    kids = Counter(p[:-1] for p in nodes if p)
    leaves, saved = Counter(), Counter()
    for p, members in nodes.items():
        own = (len(members) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += own
            leaves[p[:d]] += kids[p] == 0
    return sorted((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(
        ",".join(map(str, sorted(c for c in m if len(seqs[c]) == len(p)))).encode()).hexdigest()) for p, m in nodes.items())


def listed(df):
    return sorted(tuple(r) for r in df.select(conversation_trie.SHOWN).collect())


def trie_rows(seed, many):
    rng = random.Random(seed)
    rows = []
    for c in range(-15, many):
        if c % 7 == 3:
            continue
        kind = rng.random()
        for t in range(0 if kind < 0.1 else rng.randrange(1, 9)):
            same = kind < 0.5 or t < 2
            rows.append((c, None if t == 0 and kind > 0.8 else t, rng.choice(["user", None]) if not same else "user",
                         f"word{t} a b" if same else rng.choice(["x y", "", None, "long one here \t ok", f"z{rng.randrange(9)}"])))
    rows += [(many + 1 + i, t, "user", f"same {t}") for i in range(60) for t in range(6)]
    rows += [rows[0], rows[0], (None, 1, "user", "lost"), (5, 2, None, None), (5, 2, "a", "tie"), (5, 2, "a", "tie")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("span,shards", [(128, 4), (2, 7), (1, 3), (3, 1)])
def test_trie_equals_brute_force(spark, span, shards):
    rows = trie_rows(span, 60)
    df = spark.createDataFrame([(*r, "z", "z", 0) for r in rows], "conv_id long, turn long, role string, text string, conv string, pos string, words int")
    convs, turns = grafted(conversation_trie.ordered_turns(df))
    assert listed(conversation_trie.prefix_trie(convs, turns, span=span, shards=shards)) == sorted(brute_trie(rows), key=lambda r: r)


def test_trie_of_nothing_and_of_one_long_conversation(spark):
    schema = "conv_id long, turn long, role string, text string"
    convs, turns = grafted(conversation_trie.ordered_turns(spark.createDataFrame([], schema)))
    assert listed(conversation_trie.prefix_trie(convs, turns)) == []
    rows = [(c, t, "user", f"t{t if t < 140 else (t, c)}") for c in (40, 60) for t in range(300)]
    convs, turns = grafted(conversation_trie.ordered_turns(spark.createDataFrame(rows, schema)))
    assert listed(conversation_trie.prefix_trie(convs, turns, shards=2)) == brute_trie(rows)


def brute_audit(rows, top=200):
    docs = [(lang or "", source or "", text or "") for lang, source, text in rows]
    found = [Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))) for _, _, t in docs]
    out = []
    for lang in {d[0] for d in docs}:
        here = [(d[1], f) for d, f in zip(docs, found) if d[0] == lang]
        df, total, groups = Counter(), Counter(), {s: Counter() for s, _ in here}
        for s, f in here:
            df.update(f.keys())
        kept = {t for t, n in df.items() if n >= 3}
        for s, f in here:
            for t, n in f.items():
                if t in kept:
                    total[t] += n
                    groups[s][t] += n
        def share(c, t):
            return 1 + 1_000_000_000 * (c[t] + 1) // (sum(c.values()) + len(kept))
        f = lambda p, q: (p - q) ** 2 // q
        for s, c in groups.items():
            pairs = [(-sum(f(share(c, t), share(o, t)) for t in kept), x) for x, o in groups.items() if x != s]
            terms = [(-f(share(c, t), share(total, t)), t.encode()) for t in c if share(c, t) > share(total, t)]
            out += [(lang, s, "pair", x, -v, i + 1) for i, (v, x) in enumerate(sorted(pairs))]
            out += [(lang, s, "term", t.decode(), -v, i + 1) for i, (v, t) in enumerate(sorted(terms)) if i < top]
    return sorted(out)


@pytest.mark.parametrize("slice_rows,block_sources,top", [(500_000, 128, 200), (40, 2, 5), (7, 1, 200)])
def test_audit_equals_brute_force(spark, edge_rows, slice_rows, block_sources, top):
    rng = random.Random(slice_rows)
    words = ["Alpha", "beta", "ÉTÉ", "été", "gamma9delta", "x", "漢字", "of", "the", "zz", "q-r", "naïve"]
    rows = [(rng.choice(["en", "en", "de", None]), rng.choice(["a", "a", "b", "c", None, "d"]), " ".join(rng.choice(words) for _ in range(rng.randrange(12))))
            for _ in range(120)]
    rows += [("en", rng.choice("abc"), "one text with many copies and Words") for _ in range(70)]
    rows += [("fr", "a", None), ("fr", "b", "only once"), ("fr", None, ""), ("xx", "a", "\t\n 123")]
    rows += [("en", source, text) for _, text, source in edge_rows]
    df = spark.createDataFrame([(*r, "z", 1, 2) for r in rows], "lang string, source string, text string, term string, n int, p int")
    got = source_audit.audit(df, top=top, slice_rows=slice_rows, block_sources=block_sources)
    assert sorted(tuple(r) for r in got.collect()) == brute_audit(rows, top)
    assert source_audit.audit(df.limit(0)).count() == 0
