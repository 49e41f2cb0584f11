"""Near copies by Order MinHash, verified by aligning their five-word windows.

A text is the sequence of its five-word windows, each labelled with how often it stood before, so that
no two entries of a text are equal. A sketch draws, for each of ``bands`` x ``rows`` random orders of all
labelled windows, the two least of the text and keeps them in text order: two texts agree in an
entry if they share the least windows and have them in the same order, which is what edits disturb.
Texts that agree in a whole band are candidates.

Labelled windows being different, the alignment of two texts is the longest increasing chain of the
places of their shared windows; chains leave a band around the diagonal only as far as unmatched
windows allow. With m windows in the chain, two texts of n and k windows are near copies if
m >= threshold * (n + k - m).

Equal word sequences are one text from the start, whatever their number. In a band's bucket each text
is first paired with the bucket's ``LEADERS`` first members by as many random orders and with its
hub, the member whose buckets are the largest, so that a bucket makes pairs in proportion to its
members. Each text's most promising pair is verified first; of the others only those between texts
that no verified chain joins yet. Buckets that still hold texts of several groups are settled exactly
(``prefix_pairs``). A document's class is the least key that verified links lead to. Null texts and texts without a word stay alone. Rows repeated with key and
text have one class; null keys come first.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from hearthbook.llm.common import components, keeps_names
from hearthbook.session import materialise

SHINGLE = 5
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
LAST = np.uint64(0xFFFFFFFFFFFFFFFF)
CELLS = 1 << 20  # of the orders of a text that are in memory at once


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that looks random."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(words: np.ndarray) -> np.ndarray:
    """Labelled windows of a text's word hashes; a text of fewer words is one window."""
    if not len(words):
        return words
    width = min(SHINGLE, len(words))
    n = len(words) - width + 1
    h = np.full(n, width, np.uint64)
    for k in range(width):
        h = mix(h * MULTIPLIER + words[k:k + n])
    order = np.argsort(h, kind="stable")
    ranked = h[order]
    new = np.r_[True, ranked[1:] != ranked[:-1]]
    label = np.arange(n) - np.maximum.accumulate(np.where(new, np.arange(n), 0))
    labels = np.empty(n, np.uint64)
    labels[order] = label.astype(np.uint64)
    return np.where(labels > 0, mix(h ^ (labels * MULTIPLIER)), h)


def sketch(entries: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """One value per seed: the two least entries by that seed's order, kept in text order."""
    if len(entries) == 1:
        return mix(seeds ^ entries[0])
    out = np.empty(len(seeds), np.uint64)
    step = max(1, CELLS // len(entries))
    for at in range(0, len(seeds), step):
        some = seeds[at:at + step, None]
        drawn = (entries[None, :] ^ some) * (some | np.uint64(1))
        rows = np.arange(len(some))
        first = drawn.argmin(1)
        drawn[rows, first] = LAST
        second = drawn.argmin(1)
        early, late = np.minimum(first, second), np.maximum(first, second)
        out[at:at + step] = mix(mix(entries[early]) * MULTIPLIER + entries[late])
    return out


def chain(a: np.ndarray, b: np.ndarray, threshold: float) -> int:
    """Longest common subsequence of two sequences of different entries, within the band that can reach the threshold."""
    _, at, to = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    # with m matches needed, at most (n - m) + (k - m) entries can be skipped: the width of the band
    need = int(np.ceil(threshold * (len(a) + len(b)) / (1 + threshold) - 1e-9))
    if len(at) < need:
        return 0
    width = len(a) + len(b) - 2 * need
    near = np.abs(at - to) <= width
    at, to = at[near], to[near]
    to = to[np.argsort(at)]
    if len(to) < 2 or (np.diff(to) > 0).all():
        return len(to)
    tails: list[int] = []
    for v in to.tolist():
        i = bisect.bisect_left(tails, v)
        if i == len(tails):
            tails.append(v)
        else:
            tails[i] = v
    return len(tails)


def near_copies(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    m = chain(a, b, threshold)
    return m >= threshold * (len(a) + len(b) - m) - 1e-9


def word_hashes(text: str) -> np.ndarray:
    words = text.encode("utf-8", "surrogatepass").split()
    seen: dict[bytes, int] = {}
    out = np.empty(len(words), np.uint64)
    for i, w in enumerate(words):
        v = seen.get(w)
        if v is None:
            v = seen[w] = xxhash.xxh3_64_intdigest(w)
        out[i] = v
    return out


def sketched(docs: DataFrame, key: str, text: str, bands: int, rows: int, seed: int) -> DataFrame:
    """(k, mark, same, bands, entries): hash of the text and of its words, band hashes, windows at 32 bits."""
    kind = docs.schema[key].dataType.simpleString()
    schema = T._parse_datatype_string(f"k {kind}, mark long, same binary, bands array<long>, entries binary")
    arrow = to_arrow_schema(schema)
    seeds = mix(np.arange(1, bands * rows + 1, dtype=np.uint64) + mix(np.array([seed], np.uint64)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same, hashes, entries = [], [], []
            for value in batch.column(2).to_pylist():
                words = word_hashes(value or "")
                if not len(words):
                    same.append(None)
                    hashes.append(None)
                    entries.append(None)
                    continue
                same.append(xxhash.xxh3_128_digest(words.tobytes()))
                e = windows(words)
                drawn = sketch(e, seeds).reshape(bands, rows)
                v = np.arange(bands, dtype=np.uint64)
                for r in range(rows):
                    v = mix(v * MULTIPLIER + drawn[:, r])
                hashes.append(v.view(np.int64).tolist())
                entries.append((e >> np.uint64(32)).astype(np.uint32).tobytes())
            columns = [batch.column(0).cast(arrow.field(0).type), batch.column(1)] + [
                pa.array(x, f.type) for x, f in zip([same, hashes, entries], list(arrow)[2:], strict=True)]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return docs.select(F.col(key), F.xxhash64(text), F.col(text)).mapInArrow(scan, schema)


def verified(pairs: DataFrame, entries: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose windows align."""
    schema = T._parse_datatype_string("a long, b long")
    arrow = to_arrow_schema(schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint32) for v in (x, y))
                keep.append(near_copies(x, y, threshold))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_())).cast(arrow)

    both = pairs.join(entries.select(F.col("rid").alias("a"), F.col("entries").alias("x")), "a")
    both = both.join(entries.select(F.col("rid").alias("b"), F.col("entries").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(scan, schema)


def window_rows(texts: DataFrame) -> DataFrame:
    """(rid, part, n, w): every window of the texts (rid, part, entries), n of them in its text."""
    schema = T._parse_datatype_string("rid long, part long, n int, w int")
    arrow = to_arrow_schema(schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rid, part, value in zip(*(batch.column(i) for i in range(3)), strict=True):
                w = np.frombuffer(value.as_buffer(), np.int32)
                fixed = [np.full(len(w), x, t) for x, t in ((rid.as_py(), np.int64), (part.as_py(), np.int64), (len(w), np.int32))]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in [*fixed, w]], schema=arrow)

    return texts.select("rid", "part", "entries").mapInArrow(scan, schema)


def prefix_pairs(texts: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of texts (rid, part, entries) of different parts: all that can reach the threshold are among them.

    Near copies share a window among the n - ceil(threshold * n) + 1 rarest of each. Members of a window's
    largest part meet only those of other parts.
    """
    rows = materialise(window_rows(texts), "windows")
    held = rows.groupBy("w").agg(F.count("*").alias("texts"))
    rank = F.row_number().over(Window.partitionBy("rid").orderBy("texts", "w"))
    least = F.ceil(threshold * F.col("n") - 1e-9)
    rare = rows.join(held, "w").withColumn("at", rank).filter((F.col("at") <= F.col("n") - least + 1) & (F.col("texts") > 1))
    rare = materialise(rare.select("rid", "part", "n", "w", "at"), "rare")
    parts = rare.groupBy("w", "part").agg(F.count("*").alias("c")).groupBy("w").agg(
        F.count("*").alias("parts"), F.max_by("part", F.struct("c", "part")).alias("major"))
    mixed = rare.join(parts.filter("parts > 1").select("w", "major"), "w")
    x = mixed.filter("part != major").select("w", *[F.col(c).alias(f"{c}_x") for c in ("rid", "part", "n", "at")])
    both = x.join(mixed, "w").filter((F.col("part_x") != F.col("part")) & ((F.col("part") == F.col("major")) | (F.col("rid_x") < F.col("rid"))))
    # windows from the shared one on are all that can match, at the first that is shared
    need = F.ceil(threshold * (F.col("n_x") + F.col("n")) / (1 + threshold) - 1e-9)
    both = both.filter(1 + F.least(F.col("n_x") - F.col("at_x"), F.col("n") - F.col("at")) >= need)
    return both.select(F.least("rid_x", "rid").alias("a"), F.greatest("rid_x", "rid").alias("b")).distinct()


LEADERS = 4


def near_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8, bands: int = 20,
                 rows: int = 2, seed: int = 7) -> DataFrame:
    """(key, mark, class, kept) for every row: mark is the hash of the text, class the least key of its group.

    ``kept`` is true in one (key, mark) of each class.
    """
    seen = sketched(docs, key, text, bands, rows, seed).withColumn("rid", F.monotonically_increasing_id())
    seen = materialise(seen, "sketches")
    texts = seen.filter("same is not null").groupBy("same").agg(F.min(F.struct("k", "mark", "rid")).alias("least"))
    texts = materialise(texts.select("same", "least.*"), "texts")

    members = seen.select("rid", "bands").join(texts.select("rid"), "rid")
    members = materialise(members.select("rid", F.posexplode("bands").alias("band", "bucket")), "members")
    heads = members.groupBy("band", "bucket").agg(
        F.count("*").alias("n"), *[F.min(F.struct(F.xxhash64("rid", F.lit(i)), "rid")).alias(f"h{i}") for i in range(LEADERS)])
    heads = heads.filter("n > 1").select("band", "bucket", F.array_distinct(
        F.array(*[f"h{i}.rid" for i in range(LEADERS)])).alias("leaders"), "n")
    heads = materialise(heads, "heads")
    pairs = members.join(heads, ["band", "bucket"]).select("rid", F.explode("leaders").alias("leader"))
    # in buckets of up to LEADERS + 1 members the leaders meet all others
    crowded = members.join(heads.filter(F.col("n") > LEADERS + 1).select("band", "bucket", "n"), ["band", "bucket"])
    crowded = materialise(crowded, "crowded")
    weights = crowded.groupBy("rid").agg(F.sum("n").alias("weight"))
    hubs = crowded.join(weights, "rid").groupBy("band", "bucket").agg(F.max_by("rid", F.struct("weight", "rid")).alias("leader"))
    pairs = pairs.unionAll(crowded.join(hubs, ["band", "bucket"]).select("rid", "leader"))
    pairs = pairs.filter("rid != leader").groupBy(
        F.least("rid", "leader").alias("a"), F.greatest("rid", "leader").alias("b")).agg(F.count("*").alias("shared"))
    pairs = materialise(pairs, "pairs")

    entries = seen.select("rid", "entries")
    best = pairs.groupBy("b").agg(F.max_by("a", F.struct("shared", -F.col("a"))).alias("a")).select("a", "b")
    links = materialise(verified(best, entries, threshold), "links")
    groups = materialise(components(links), "groups")
    side = lambda c: groups.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
    rest = pairs.select("a", "b").join(best, ["a", "b"], "left_anti").join(side("a"), "a", "left").join(side("b"), "b", "left")
    rest = rest.filter("of_a is null or of_b is null or of_a != of_b").select("a", "b")
    more = materialise(verified(rest, entries, threshold), "links")
    links = links.unionAll(more)
    groups = components(links).withColumnRenamed("node", "rid")

    parted = crowded.join(groups, "rid", "left").withColumn("part", F.coalesce("component", "rid"))
    unsettled = parted.groupBy("band", "bucket").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low != high")
    unsettled = parted.join(unsettled, ["band", "bucket"]).select("rid", "part").distinct()
    left = prefix_pairs(unsettled.join(entries, "rid"), threshold).join(pairs.select("a", "b"), ["a", "b"], "left_anti")
    last = materialise(verified(left, entries, threshold), "links")
    if not last.isEmpty():
        groups = components(links.unionAll(last)).withColumnRenamed("node", "rid")

    named = texts.join(groups, "rid", "left").withColumn("component", F.coalesce("component", "rid"))
    named = materialise(named.select("same", "rid", "component", "k", "mark"), "named")
    least = named.groupBy("component").agg(F.min(F.struct("k", "mark")).alias("least"))
    named = named.select("same", "component").join(least, "component").select("same", "least")
    out = seen.select("k", "mark", "same").join(named, "same", "left")
    alone = F.col("same").isNull()
    return out.select(
        F.col("k").alias(key), "mark", F.when(alone, F.col("k")).otherwise(F.col("least.k")).alias("class"),
        (alone | (F.struct("k", "mark") == F.col("least"))).alias("kept"))


@keeps_names
def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One document of each class, with its columns as they were; rows repeated with key and text leave one."""
    kept = near_classes(docs, key, text, **options).filter("kept").select(F.col(key).alias("_k"), F.col("mark").alias("_m"))
    marked = docs.withColumn("_m", F.xxhash64(text)).withColumn("_k", F.col(key))
    on = marked["_k"].eqNullSafe(kept["_k"]) & (marked["_m"] == kept["_m"])
    return marked.join(kept, on, "left_semi").dropDuplicates(["_k", "_m"]).drop("_k", "_m")
