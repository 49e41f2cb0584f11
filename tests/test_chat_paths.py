"""The current path through trees: dead branches, deep chains, orphans; jumps get fewer each round."""

import random

from hearthbook.operators import chat


def test_paths_equal_the_walk_and_jumps_shrink(spark, monkeypatch):
    rng = random.Random(6)
    nodes, current = [], []
    for c in range(12):
        size = rng.randrange(1, 60)
        for i in range(size):
            nodes.append((c, f"n{i}", None if i == 0 else f"n{rng.randrange(max(0, i - 4), i)}"))
        current.append((c, f"n{rng.randrange(size)}"))
    nodes += [(90, f"k{i}", f"k{i - 1}" if i else None) for i in range(300)] + [(90, f"dead{i}", f"k{i}") for i in range(300)]
    nodes += [(91, "a", "lost"), (91, "b", "a"), (92, "x", None)]
    current += [(90, "k299"), (91, "b"), (93, "gone")]
    stored = []
    plain = chat.materialise

    def counting(df, name="stage"):
        out = plain(df, name)
        stored.append((out.columns, out.count()))
        return out
    monkeypatch.setattr(chat, "materialise", counting)
    got = chat.path_rows(spark.createDataFrame(nodes, "conv int, node string, parent string"), "conv", "node", "parent",
                         spark.createDataFrame(current, "conv int, node string"))
    up = {(c, n): p for c, n, p in nodes}
    want = []
    for c, n in current:
        path = []
        while (c, n) in up:
            path.append(n)
            n = up[(c, n)]
        want += [(c, n, i) for i, n in enumerate(reversed(path))]
    assert sorted((r.conv, r.node, r.pos) for r in got.collect()) == sorted(want)
    jumps = [n for columns, n in stored if columns == ["c", "n", "up"]]
    assert jumps == sorted(jumps, reverse=True) and jumps[0] < 650 and len(jumps) <= 11
