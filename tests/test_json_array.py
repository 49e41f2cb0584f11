"""Elements of JSON arrays cut out by blocks: strings, escapes and brackets in any place."""

import json
import random

from hearthbook.sources.json_array import json_elements


def value(rng, depth=0):
    kind = rng.random()
    if depth > 3 or kind < 0.3:
        return rng.choice(["a}b", "[x", '"q\\', "é\n}{", "", None, 1.5, True, '\\"'])
    if kind < 0.6:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {f"k{rng.randrange(9)}}}": value(rng, depth + 1) for _ in range(rng.randrange(4))}


def test_elements_come_whole_and_in_order_from_any_block_size(spark, tmp_path):
    rng = random.Random(1)
    rows = [{"id": i, "v": value(rng), "t": "x}" * rng.randrange(50)} for i in range(300)] + [7, "s", None, [1, [2]]]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    (tmp_path / "b.json").write_text(json.dumps(rows[:7], indent=1, ensure_ascii=False) + "\n", encoding="utf-8")
    (tmp_path / "c.json").write_text("[]")
    (tmp_path / "d.json").write_text("")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        for size in (1 << 27, 1000, 150):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            got = json_elements(spark, str(tmp_path)).orderBy("file", "block", "number").collect()
            assert [json.loads(r.value) for r in got if r.file.endswith("a.json")] == rows
            assert [json.loads(r.value) for r in got if r.file.endswith("b.json")] == rows[:7]
            assert len(got) == len(rows) + 7
            if size < 2000:
                assert len({r.block for r in got}) > 20
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
