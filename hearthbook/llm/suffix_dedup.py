"""Repeated byte strings across documents, by a column-wise collection transform.

Every byte covered by a string of ``length`` bytes that also starts earlier (smaller key, or the same
document further left) is removed; strings are judged on the input and may overlap.

1. Anchors cut the corpus into pieces that can be compared apart. The anchor of a string is its least
   32-byte gram by a hash; neighbouring strings with one anchor form a piece. Equal strings have equal
   anchors in the same place, so only pieces with an anchor that stands more than once can repeat; the
   others are dropped after anchors were counted.
2. Equal pieces need no further look: all but the first are repeats as they are.
3. Different pieces around one anchor are laid out by it, one symbol of each per column, and the columns
   are written one after the other to a sequential file. From the last column to the first, one symbol of
   every piece is inserted per round: the order of the pieces by what follows (the collection's
   Burrows-Wheeler permutation at that column) and the common prefixes of neighbours are carried from
   column to column. Neighbours with a common prefix of ``length`` are the interval of one string; all
   but the first of its places are repeats.
4. Repeats become byte ranges per document, merged into maximal removed runs.

Pieces around one anchor are parted further by the 66 bytes that all strings on the anchor's left or
right half share. An anchor that still has more than ``crowd`` different pieces is compared string by
string, by a 128-bit hash aggregated over the cluster, which gives the same result.

Null texts are empty. Documents of equal text are cut up once; from the second on, all their bytes are
repeats if there are ``length`` or more. Rows repeated with key and text are one document. Keys used for
different texts are taken in the order of the texts' hash; null keys come first.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from hearthbook.llm.common import release, slices
from hearthbook.session import materialise

GRAM = 32
SLAB = 4096
MOST = 2 << 20  # bytes of text, or compressed text, looked at together
TOGETHER = 1 << 16  # bytes of short texts that are anchored in one go
WIDE = 1 << 16  # a piece's place and its number of strings travel as one number
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class Powers:
    """Powers of the base and of its inverse, as far as needed so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            self.up = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, BASE)])
            self.down = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, INVERSE)])


POWERS = Powers()


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of every gram of some bytes, by differences of running sums."""
    POWERS.upto(len(data) + 1)
    wide = data.astype(np.uint64)
    wide += np.uint64(1)
    wide *= POWERS.down[:len(wide)]
    sums = np.zeros(len(wide) + 1, np.uint64)
    np.cumsum(wide, out=sums[1:])
    value = sums[GRAM:] - sums[:-GRAM]
    value *= POWERS.up[:len(value)]
    value ^= value >> np.uint64(29)
    value *= np.uint64(0xBF58476D1CE4E5B9)
    value ^= value >> np.uint64(32)
    return value


def anchored(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of some texts: number of the text, first string, number of strings, place of the anchor, its hash.

    The texts are read as one run of bytes; strings that would cross from one to the next are left out. Grams are
    compared by the upper half of their hashes, the leftmost of equals counts.
    """
    width = length - GRAM + 1
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begins, counts = np.cumsum(sizes) - sizes, np.maximum(sizes - length + 1, 0)
    total = int(counts.sum())
    if not total:
        none = np.empty(0, np.int64)
        return none, none, none, none, np.empty(0, np.uint64)
    value = gram_hashes(np.frombuffer(b"".join(texts), np.uint8))
    brief = (value >> np.uint64(32)).astype(np.uint32)
    least, span = brief, 1
    while span < width:
        step = min(span, width - span)
        least = np.minimum(least[step:], least[:-step])
        span += step
    # the strings inside texts, and where another least gram or another text begins among them
    owner = np.repeat(np.arange(len(texts)), counts)
    at = np.arange(total) + (begins - (np.cumsum(counts) - counts))[owner]
    inside = least[at]
    fresh = np.ones(total, bool)
    np.not_equal(inside[1:], inside[:-1], out=fresh[1:])
    other = np.zeros(total, bool)
    other[np.cumsum(counts)[counts > 0] - counts[counts > 0]] = True
    fresh |= other
    first = np.flatnonzero(fresh)
    # a smaller least gram has come in on the right; of a greater one the place is looked for
    came = np.zeros(len(first), bool)
    came[1:] = (inside[first[1:]] < inside[first[1:] - 1]) & ~other[first[1:]]
    stop = np.append(first[1:], total)
    found, ahead = [], np.arange(width)
    while len(first):
        start = at[first]
        place = start + (width - 1)
        seek = np.flatnonzero(~came)
        for i in range(0, len(seek), SLAB):
            rows = seek[i:i + SLAB]
            near = brief[start[rows, None] + ahead] == inside[first[rows], None]
            place[rows] = start[rows] + near.argmax(1)
        found.append((first, place))
        # strings beyond the anchor that have the same least gram once more
        beyond = first + (place + 1 - start)
        more = beyond < stop
        first, stop = beyond[more], stop[more]
        came = np.zeros(len(first), bool)
    first, place = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(first, kind="stable")
    first, place = first[order], place[order]
    whose = owner[first]
    n = np.diff(np.append(first, total))
    return whose, at[first] - begins[whose], n, place - begins[whose], value[place]


def anchors(raw: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of a text: first string, number of strings, place of the anchor, its hash."""
    return anchored([raw], length)[1:]


def together(texts: list[bytes], most: int = TOGETHER) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first, texts): short texts in groups of about ``most`` bytes, long ones alone."""
    low, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= most:
            yield low, texts[low:i + 1]
            low, held = i + 1, 0
    if low < len(texts):
        yield low, texts[low:]


def sorted_rounds(columns, count: int, group: np.ndarray, age: np.ndarray, low: np.ndarray, high: np.ndarray,
                  width: int, length: int) -> np.ndarray:
    """(piece, column) marks of strings that start at the column and are not the first of their kind.

    ``columns(c)`` gives the symbols of column c; piece i has columns low[i] to high[i]; ``age`` ranks pieces.
    """
    marks = np.zeros((count, width - length + 1), bool)
    order = np.argsort(group, kind="stable")
    common = np.zeros(count, np.int64)  # with the neighbour before
    for c in range(width - 1, -1, -1):
        symbol = columns(c).astype(np.int64)
        inside = (low <= c) & (c < high)
        code = (group * 257 + np.where(inside, symbol, 256))[order]
        turn = np.argsort(code, kind="stable")
        # least common prefix between neighbours-to-be, over the stretch that lay between them
        table, levels = [common], 0
        while 2 << levels <= count:
            last = table[-1]
            table.append(np.minimum(last[:-(1 << levels)], last[1 << levels:]))
            levels += 1
        before, here = turn[:-1], turn[1:]
        same = (code[before] == code[here]) & inside[order[here]] & inside[order[before]]
        fresh = np.zeros(count, np.int64)
        if same.any():
            lo, hi = before[same] + 1, here[same]
            depth = np.frexp((hi - lo + 1).astype(float))[1] - 1
            found = np.empty(len(lo), np.int64)
            for d in np.unique(depth):
                at = depth == d
                found[at] = np.minimum(table[d][lo[at]], table[d][hi[at] - (1 << d) + 1])
            fresh[1:][same] = found + 1
        order, common = order[turn], fresh
        if c <= width - length:
            opens = common < length
            starts = np.flatnonzero(opens)
            ages = age[order]
            first = np.minimum.reduceat(ages, starts)[np.cumsum(opens) - 1]
            again = order[ages != first]
            marks[again, c] = True
    return marks


def runs_of(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first column, columns) of the runs of marks."""
    edge = np.diff(np.pad(marks, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, start = np.nonzero(edge == 1)
    _, end = np.nonzero(edge == -1)
    return row, start, end - start


def compare(pieces: pa.Table, length: int) -> pa.Table:
    """Repeats (k, h, at, n) among the different pieces of some anchors."""
    count, reach = pieces.num_rows, length - GRAM
    width = reach + length
    part, at, left = (pieces[c].to_numpy() for c in ("part", "at", "left"))
    raws = pieces["bytes"].to_pylist()
    group = np.unique(part, return_inverse=True)[1]
    low = reach - left
    size = np.array([len(r) for r in raws])
    # earlier documents first, then earlier places: strings in one column stand in the order of their anchors
    keyed = pieces.select(["k", "h"]).append_column("p", pa.array(at + left))
    age = np.empty(count, np.int64)
    age[pc.sort_indices(keyed, [(c, "ascending") for c in ("k", "h", "p")], null_placement="at_start").to_numpy()] = np.arange(count)
    with tempfile.TemporaryFile() as f:
        for begin in range(0, count, SLAB):  # laid out in slabs, then written column by column
            grid = np.zeros((min(SLAB, count - begin), width), np.uint8)
            for i, raw in enumerate(raws[begin:begin + SLAB]):
                grid[i, low[begin + i]:low[begin + i] + len(raw)] = np.frombuffer(raw, np.uint8)
            f.write(np.ascontiguousarray(grid.T).tobytes())

        def column(c: int) -> np.ndarray:
            out = []
            for begin in range(0, count, SLAB):
                n = min(SLAB, count - begin)
                f.seek(begin * width + c * n)
                out.append(np.frombuffer(f.read(n), np.uint8))
            return np.concatenate(out)

        marks = sorted_rounds(column, count, group, age, low, low + size, width, length)
    row, start, n = runs_of(marks)
    whose = pieces.select(["k", "h"]).take(row)
    return whose.append_column("at", pa.array(at[row] + start - low[row])).append_column("n", pa.array(n.astype(np.int64)))


def mapped(df: DataFrame, fn, schema: str | T.StructType) -> DataFrame:
    """``fn(batch) -> list of Arrow arrays`` over parts of Arrow batches; the third column holds their bulk."""
    out = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(out)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, pc.binary_length(batch.column(2)), MOST):
                columns = [c if isinstance(c, pa.Array) else pa.array(c) for c in fn(part)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(scan, out)


def packed_texts(docs: DataFrame, kind: str) -> DataFrame:
    """(k, h, z): texts as compressed bytes, as they travel."""
    def pack(batch: pa.RecordBatch) -> list:
        z = zstandard.ZstdCompressor(level=2)
        texts = [z.compress(t.encode("utf-8", "surrogatepass")) for t in batch.column(2).to_pylist()]
        return [batch.column(0), batch.column(1), pa.array(texts, pa.binary())]

    return mapped(docs, pack, f"k {kind}, h long, z binary")


def unpack(z: bytes, tool: zstandard.ZstdDecompressor) -> bytes:
    return tool.decompress(z) if zstandard.frame_content_size(z) else b""


def repeats(docs: DataFrame, firsts: DataFrame, kind: str, length: int, crowd: int) -> DataFrame:
    """(k, h, at, n): n strings from byte ``at`` on start earlier too; of texts (k, h, t) those in ``firsts``."""
    spark = docs.sparkSession

    def places(batch: pa.RecordBatch) -> list:
        rows, keys, ats = [], [], []
        for low, texts in together([t.encode("utf-8", "surrogatepass") for t in batch.column(2).to_pylist()]):
            row, start, n, _, key = anchored(texts, length)
            rows.append(low + row)
            keys.append(key.view(np.int64))
            ats.append(start * WIDE + n)
        rows = np.concatenate(rows) if rows else np.empty(0, np.int64)
        at = pa.array(rows)
        return [batch.column(0).take(at), batch.column(1).take(at), *[
            np.concatenate(x) if x else np.empty(0, np.int64) for x in (keys, ats)]]

    found = mapped(docs, places, f"k {kind}, h long, anchor long, at long")
    often = materialise(found.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor"), "anchors")
    release(spark)
    wanted = found.join(often, "anchor").groupBy("k", "h").agg(F.collect_set("at").alias("ats"))
    wanted = wanted.join(firsts, wanted["k"].eqNullSafe(firsts["k"]) & (wanted["h"] == firsts["h"]), "left_semi")
    texts = packed_texts(docs, kind)
    mine = lambda other: texts["k"].eqNullSafe(other["k"]) & (texts["h"] == other["h"])
    half = (length - GRAM) // 2

    def look(batch: pa.RecordBatch) -> list:
        tool = zstandard.ZstdDecompressor()
        rows, out = [], []
        wanted = batch.column(3).to_pylist()
        for first, raws in together([unpack(z, tool) for z in batch.column(2).to_pylist()]):
            row, start, n, place, _ = anchored(raws, length)
            mine = np.array([i << 48 | at for i in range(len(raws)) for at in wanted[first + i]], np.int64)
            keep = np.isin((row << 48) | (start * WIDE + n), mine)
            for i, a, m, p in zip(row[keep].tolist(), start[keep].tolist(), n[keep].tolist(), place[keep].tolist(), strict=True):
                raw = raws[i]
                # strings that hold `half` bytes or more right of the anchor, and the others
                middle = min(max(a, p - half), a + m)
                for low, high, shared in ((middle, a + m, raw[p:p + GRAM + half]), (a, middle, raw[p - half:p + GRAM])):
                    if low < high:
                        rows.append(first + i)
                        same = xxhash.xxh3_64_intdigest(raw[low:high + length - 1], p - low)
                        out.append((signed(xxhash.xxh3_64_intdigest(shared)), signed(same), low, p - low, high - low))
        at = pa.array(rows, pa.int64())
        return [batch.column(0).take(at), batch.column(1).take(at), *[
            pa.array([o[c] for o in out], pa.int64()) for c in range(5)]]

    chosen = texts.join(wanted, mine(wanted)).select(texts["k"], texts["h"], "z", "ats")
    pieces = materialise(mapped(chosen, look, f"k {kind}, h long, part long, same long, at long, left long, n long"), "pieces")
    release(spark, often)
    # equal pieces: all but the first repeat as a whole
    place = F.struct("k", "h", "at", "left", "n")
    heads = materialise(pieces.groupBy("part", "same").agg(F.min(place).alias("head")), "heads")
    again = pieces.join(heads, ["part", "same"]).filter(place != F.col("head")).select("k", "h", "at", "n")
    # different pieces of one part, cut out of their texts
    parts = heads.groupBy("part").agg(F.count("*").alias("kinds")).filter("kinds > 1")
    apart = materialise(heads.join(parts, "part").select("head.*", "part", "kinds"), "apart")
    release(spark)
    listed = apart.groupBy("k", "h").agg(F.collect_set(F.struct("part", "at", "left", "n", "kinds")).alias("cuts"))

    def cut(batch: pa.RecordBatch) -> list:
        tool = zstandard.ZstdDecompressor()
        rows, out, raws = [], [], []
        for i, (z, cuts) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
            raw = unpack(z, tool)
            for c in cuts:
                rows.append(i)
                out.append((c["part"], c["at"], c["left"], c["kinds"]))
                raws.append(raw[c["at"]:c["at"] + c["n"] + length - 1])
        at = pa.array(rows, pa.int64())
        return [batch.column(0).take(at), batch.column(1).take(at), pa.array(raws, pa.binary()), *[
            pa.array([o[c] for o in out], pa.int64()) for c in range(4)]]

    chosen = texts.join(listed, mine(listed)).select(texts["k"], texts["h"], "z", "cuts")
    bare = materialise(mapped(chosen, cut, f"k {kind}, h long, bytes binary, part long, at long, left long, kinds long"), "cuts")
    release(spark, apart)
    some = bare.filter(F.col("kinds") <= crowd)
    buckets = max(1, -(-some.count() // 20_000))
    schema = f"k {kind}, h long, at long, n long"
    close = some.select("k", "h", "part", "at", "left", "bytes", F.pmod(F.xxhash64("part"), F.lit(buckets)).alias("bucket"))
    found = close.groupBy("bucket").applyInArrow(comparing(length), schema)
    return again.unionAll(found).unionAll(one_by_one(bare.filter(F.col("kinds") > crowd), kind, length))


def comparing(length: int):
    def run(pieces: pa.Table) -> pa.Table:
        return compare(pieces, length)
    return run


def one_by_one(pieces: DataFrame, kind: str, length: int) -> DataFrame:
    """Repeats among pieces of crowded anchors: every string by its hash."""
    def strings(batch: pa.RecordBatch) -> list:
        rows, at, hashes = [], [], []
        for i, (a, raw) in enumerate(zip(batch.column(3).to_pylist(), batch.column(2).to_pylist(), strict=True)):
            for o in range(len(raw) - length + 1):
                rows.append(i)
                at.append(a + o)
                hashes.append(xxhash.xxh3_128_digest(raw[o:o + length]))
        rows = pa.array(rows, pa.int64())
        return [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(at, pa.int64()), pa.array(hashes, pa.binary())]

    each = mapped(pieces.select("k", "h", "bytes", "at"), strings, f"k {kind}, h long, at long, string binary")
    place = F.struct("k", "h", "at")
    heads = each.groupBy("string").agg(F.min(place).alias("head"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return each.join(heads, "string").filter(place != F.col("head")).select("k", "h", "at", F.lit(1).cast("long").alias("n"))


def signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def remove(raw: bytes, starts: list[int], counts: list[int], length: int) -> tuple[int, int, bytes]:
    """Removed bytes, maximal removed runs and what is left."""
    out, done, gone, spans, end = [], 0, 0, 0, -1
    for a, n in sorted(zip(starts, counts, strict=True)):
        b = a + n + length - 1
        spans += a > end
        if b > end:
            new = max(a, end)
            gone += b - new
            out.append(raw[done:new])
            done = end = b
    out.append(raw[done:])
    return gone, spans, b"".join(out)


def drop_repeated_bytes(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 100, crowd: int = 100_000) -> DataFrame:
    """One row per row of ``docs``: key, n_bytes, n_removed, n_spans and kept, the bytes that are left."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = rows.select("k", F.xxhash64("t").alias("h"), "t")
    # of equal texts the first document is cut up, the others go whole
    brief = rows.select("k", "h", F.hash("t").alias("h2"), F.octet_length("t").alias("size"))
    ranked = brief.groupBy("h", "h2", "size").agg(F.min(F.struct("k")).alias("first"))
    ranked = materialise(ranked.filter(F.col("size") >= length), "firsts")
    firsts = ranked.select("first.k", "h")
    whole = brief.join(ranked, ["h", "h2", "size"]).filter(F.struct("k") != F.col("first"))
    whole = whole.select("k", "h", F.lit(0).cast("long").alias("at"), (F.col("size") - length + 1).cast("long").alias("n"))
    found = repeats(rows, firsts, kind, length, crowd).unionAll(whole.distinct())
    found = found.groupBy("k", "h").agg(F.collect_set(F.struct("at", "n")).alias("runs"))
    found = materialise(found.select("k", "h", "runs.at", "runs.n"), "runs")
    texts = packed_texts(rows, kind)
    release(docs.sparkSession)
    joined = texts.join(found, texts["k"].eqNullSafe(found["k"]) & (texts["h"] == found["h"]), "left").select(texts["k"], "at", "z", "n")

    def cut(batch: pa.RecordBatch) -> list:
        tool = zstandard.ZstdDecompressor()
        sizes, gone, spans, kept = [], [], [], []
        for z, at, n in zip(*[batch.column(i).to_pylist() for i in (2, 1, 3)], strict=True):
            raw = unpack(z, tool)
            g, s, left = remove(raw, at or [], n or [], length)
            sizes.append(len(raw))
            gone.append(g)
            spans.append(s)
            kept.append(left)
        return [batch.column(0), *[pa.array(x, pa.int64()) for x in (sizes, gone, spans)], pa.array(kept, pa.binary())]

    return mapped(joined, cut, f"`{key}` {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
