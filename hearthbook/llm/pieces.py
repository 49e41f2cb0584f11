"""SentencePiece encoding and decoding for byte-fallback BPE models, by suffix-array matching.

A batch's different chunks - a word with the spaces before it - are put into one text. Its suffixes are
sorted to the depth of the longest piece by prefix doubling; every piece of the vocabulary finds its
range of suffixes by binary search, one character after the other, all pieces at once. The ranges give
the edges (start, end, piece) of the batch, sorted by position. The chunks are then relaxed over their
edges: of the edges that join two neighbours a chunk takes the best-scored, leftmost one, until none is
left, and what no piece covers becomes bytes. This is the order in which the model itself merges.

Chunks may be treated alone if no piece has a space mark behind another character; for other
vocabularies the whole text is one chunk. Models without byte fallback or with a normaliser that
changes texts are refused. Null texts have null ids and decode to null, empty ones have none.
Rows are encoded alone; other columns pass through ``encode`` unchanged.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from hearthbook.llm.common import slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
BREAK = "\0"  # between chunks; in no piece
CACHE = 600_000  # chunks remembered by a task


class Vocabulary:
    """The pieces of a model as tables."""

    def __init__(self, model: bytes):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = range(p.get_piece_size())
        text = [p.id_to_piece(i) for i in ids]
        self.byte = {int(text[i][3:5], 16): i for i in ids if p.is_byte(i)}
        probe = "a  Bé\n½ "
        if len(self.byte) != 256 or p.decode(p.encode(probe)) != probe or p.decode(p.encode(" x")) != " x":
            raise ValueError("only byte-fallback models that keep texts as they are can be matched")
        self.prefix = p.encode("x", out_type=str)[0].startswith(SPACE)
        normal = [i for i in ids if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i)) and BREAK not in text[i]]
        self.ids = np.array(normal, np.int64)
        self.length = np.array([len(text[i]) for i in normal], np.int64)
        self.depth = int(self.length.max())
        self.points = np.zeros((len(normal), self.depth), np.uint32)
        for row, i in enumerate(normal):
            self.points[row, :len(text[i])] = [ord(c) for c in text[i]]
        scores = np.array([p.get_score(i) for i in normal])
        self.turns = np.zeros(len(text), np.int64)  # order in which pieces are made, best first
        self.turns[normal] = np.unique(-scores, return_inverse=True)[1]
        self.apart = not any(SPACE in text[i].lstrip(SPACE) for i in normal)
        self.raw = [b"" if p.is_control(i) or p.is_unknown(i) else text[i].encode() for i in ids]
        for value, i in self.byte.items():
            self.raw[i] = bytes([value])
        # characters that no piece holds stand alone
        alone = "".join(c for c in "\n\t\r" if not any(c in text[i] for i in normal))
        self.chunk = re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+|[{alone or BREAK}]" if self.apart else "(?s).+")


@lru_cache(maxsize=2)
def vocabulary(model: bytes) -> Vocabulary:
    return Vocabulary(model)


def suffix_array(points: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first ``depth`` characters or more."""
    rank = np.unique(points, return_inverse=True)[1].astype(np.int64) + 1
    step = 1
    while step < depth:
        then = np.zeros_like(rank)
        then[:-step] = rank[step:] if step < len(rank) else 0
        rank = np.unique(rank * (int(rank.max()) + 1) + then, return_inverse=True)[1].astype(np.int64) + 1
        step *= 2
    return np.argsort(rank, kind="stable")


def bound(column: np.ndarray, lo: np.ndarray, hi: np.ndarray, value: np.ndarray, right: bool) -> np.ndarray:
    """Binary search in many stretches of one column at once."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        todo = lo < hi
        if not todo.any():
            return lo
        mid = (lo + hi) // 2
        seen = column[np.minimum(mid, len(column) - 1)]
        up = todo & ((seen <= value) if right else (seen < value))
        lo = np.where(up, mid + 1, lo)
        hi = np.where(todo & ~up, mid, hi)


def edges(points: np.ndarray, v: Vocabulary) -> np.ndarray:
    """Every occurrence of every piece, by position: [start, length] holds the piece, or -1."""
    order = suffix_array(points, v.depth)
    padded = np.concatenate([points, np.zeros(v.depth, np.uint32)])
    edge = np.full((len(points), v.depth + 1), -1, np.int32)
    rows = np.arange(len(v.ids))
    lo, hi = np.zeros(len(rows), np.int64), np.full(len(rows), len(points), np.int64)
    for d in range(v.depth):
        column, want = padded[order + d], v.points[rows, d]
        lo, hi = bound(column, lo, hi, want, False), bound(column, lo, hi, want, True)
        there = hi > lo
        rows, lo, hi = rows[there], lo[there], hi[there]
        done = v.length[rows] == d + 1
        n = (hi - lo)[done]
        at = np.repeat(lo[done] - np.cumsum(n) + n, n) + np.arange(n.sum())
        edge[order[at], d + 1] = np.repeat(v.ids[rows[done]], n)  # put in its place: sorted by position
        rows, lo, hi = rows[~done], lo[~done], hi[~done]
    return edge


def relax(starts: np.ndarray, ends: np.ndarray, edge: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the pieces that the stretches end up in, all stretches at once.

    ``edge[start, length]`` is the piece there, or -1. In a round every stretch takes its best edge between
    neighbours; stretches without one are done and leave.
    """
    at = np.repeat(starts - np.cumsum(ends - starts) + (ends - starts), ends - starts) + np.arange((ends - starts).sum())
    size = np.ones(len(at), np.int64)
    owner = np.repeat(np.arange(len(starts)), ends - starts)
    done_at, done_size = [], []
    while len(at):
        both = np.append(size[:-1] + size[1:], 0)
        fits = np.append(owner[:-1] == owner[1:], False) & (both <= v.depth)
        piece = np.where(fits, edge[at, np.where(fits, both, 0)], -1)
        turn = np.where(piece >= 0, v.turns[piece], NEVER)
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        best = np.minimum.reduceat(turn << PLACE_BITS | np.arange(len(at)), first)
        stuck = best >> PLACE_BITS >= NEVER
        take = (best & PLACES)[~stuck]
        size[take] += size[take + 1]
        over = np.repeat(stuck, np.diff(np.append(first, len(at))))
        done_at.append(at[over])
        done_size.append(size[over])
        over[take + 1] = True
        at, size, owner = at[~over], size[~over], owner[~over]
    at, size = np.concatenate(done_at), np.concatenate(done_size)
    order = np.argsort(at)
    return at[order], size[order]


NEVER, PLACE_BITS = np.int64(1 << 30), np.int64(32)
PLACES = np.int64((1 << 32) - 1)


def relax_long(text: str, at: int, edge: np.ndarray, v: Vocabulary) -> list[tuple[int, int]]:
    """The same for one long stretch, its edges in a heap: work grows with n log n, not with rounds."""
    n = len(text)
    size, before, heap = [1] * n, list(range(-1, n - 1)), []

    def offer(i: int, length: int) -> None:
        piece = edge[at + i, length] if length <= v.depth else -1
        if piece >= 0:
            heapq.heappush(heap, (int(v.turns[piece]), i, length))

    for i in range(n - 1):
        offer(i, 2)
    while heap:
        _, i, length = heapq.heappop(heap)
        j = i + size[i]
        if not size[i] or j >= n or size[i] + size[j] != length:
            continue
        size[i], size[j], after = length, 0, i + length
        if after < n:
            before[after] = i
            offer(i, length + size[after])
        if before[i] >= 0:
            offer(before[i], size[before[i]] + length)
    return [(at + i, m) for i, m in enumerate(size) if m]


def encode_chunks(chunks: list[str], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The ids of different chunks, matched together: all ids after each other, and how many each chunk has."""
    text = BREAK.join(chunks)
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    edge = edges(points, v)
    lengths = np.array([len(c) for c in chunks])
    starts = np.cumsum(lengths + 1) - lengths - 1
    short = lengths <= LONG
    at, size = relax(starts[short], (starts + lengths)[short], edge, v) if short.any() else (np.empty(0, np.int64),) * 2
    rest = [x for i in np.flatnonzero(~short) for x in relax_long(chunks[i], int(starts[i]), edge, v)]
    if rest:
        at, size = np.append(at, [a for a, _ in rest]), np.append(size, [n for _, n in rest])
        order = np.argsort(at)
        at, size = at[order], size[order]
    ids, copies = edge[at, size], np.ones(len(at), np.int64)
    # a character without a piece is its bytes
    bare = np.flatnonzero(ids < 0)
    raw = [text[a].encode() for a in at[bare].tolist()]
    copies[bare] = [len(r) for r in raw]
    begin = np.cumsum(copies) - copies
    out = np.repeat(ids, copies)
    for a, r in zip(begin[bare].tolist(), raw, strict=True):
        out[a:a + len(r)] = [v.byte[b] for b in r]
    firsts = np.append(begin, len(out))[np.searchsorted(at, starts)]
    return out, np.diff(np.append(firsts, len(out)))


class Known:
    """Chunks met so far with their ids, the ids in one array."""

    def __init__(self) -> None:
        self.place: dict[str, int] = {}
        self.first, self.ids = np.zeros(1, np.int64), np.empty(0, np.int32)

    def add(self, chunks: list[str], v: Vocabulary) -> None:
        # matched in blocks, so that the index stays small
        blocks, block, held = [], [], 0
        for c in chunks:
            block.append(c)
            held += len(c) + 1
            if held > BLOCK:
                blocks.append(block)
                block, held = [], 0
        found = [encode_chunks(b, v) for b in [*blocks, block] if b]
        self.place.update(zip(chunks, range(len(self.place), len(self.place) + len(chunks)), strict=True))
        self.ids = np.concatenate([self.ids, *[i for i, _ in found]])
        counts = np.concatenate([np.diff(self.first), *[n for _, n in found]])
        self.first = np.r_[0, np.cumsum(counts)]


LONG = 48  # characters up to which stretches are relaxed together
BLOCK = 250_000  # characters indexed together


def encode_batch(texts: list[str | None], v: Vocabulary, known: Known) -> pa.ListArray:
    """The ids of every text; null for null."""
    parts = [[] if t is None else v.chunk.findall(SPACE * (v.prefix and t != "") + t.replace(" ", SPACE)) for t in texts]
    every = list(chain.from_iterable(parts))
    if len(known.place) > CACHE:
        known.__init__()
    new = [c for c in dict.fromkeys(every) if c not in known.place]
    if new:
        known.add(new, v)
    which = np.fromiter(map(known.place.__getitem__, every), np.int64, len(every))
    counts = known.first[which + 1] - known.first[which]
    upto = np.r_[0, np.cumsum(counts)]
    ids = known.ids[np.repeat(known.first[which] - upto[:-1], counts) + np.arange(upto[-1])]
    ends = upto[np.cumsum([0, *map(len, parts)])]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids), mask=pa.array([t is None for t in texts]))


def decode_ids(ids: list[int], v: Vocabulary) -> str:
    text = b"".join(map(v.raw.__getitem__, ids)).decode("utf-8", "replace").replace(SPACE, " ")
    return text[1:] if v.prefix and text.startswith(" ") else text


STEP = 4 << 20  # bytes of text encoded together


def load_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, text: str = "text", ids: str = "ids", model: str = MODEL, round_trip: str | None = None) -> DataFrame:
    """``docs`` with the ids of ``text`` in a further column. The model file, a few MB at most, is sent to the tasks.

    With ``round_trip`` a column of that name says whether the ids, decoded in the same task, give the text back.
    Columns that have these names already are replaced.
    """
    docs = docs.drop(ids, *([round_trip] if round_trip else []))
    sent = docs.sparkSession.sparkContext.broadcast(load_model(model))
    more = [T.StructField(ids, T.ArrayType(T.IntegerType())), *([T.StructField(round_trip, T.BooleanType())] if round_trip else [])]
    schema = T.StructType([*docs.schema.fields, *more])
    arrow = to_arrow_schema(schema)
    at = docs.columns.index(text)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, known = vocabulary(sent.value), Known()
        for batch in batches:
            for part in slices(batch, pc.binary_length(batch.column(at)), STEP):
                texts = part.column(at).to_pylist()
                got = encode_batch(texts, v, known)
                columns = [c.cast(f.type) for c, f in zip(part.columns, arrow, strict=False)] + [got.cast(arrow.field(ids).type)]
                if round_trip:
                    ends, flat = got.offsets.to_pylist(), got.values.to_numpy()
                    columns.append(pa.array([t is None or decode_ids(flat[a:b].tolist(), v) == t
                                             for t, a, b in zip(texts, ends, ends[1:], strict=False)], pa.bool_()))
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return docs.mapInArrow(scan, schema)


def decode(tokens: DataFrame, ids: str = "ids", text: str = "decoded", model: str = MODEL) -> DataFrame:
    """``tokens`` with the text that ``ids`` stand for in a further column, in place of one that has its name."""
    tokens = tokens.drop(text)
    sent = tokens.sparkSession.sparkContext.broadcast(load_model(model))
    schema = T.StructType([*tokens.schema.fields, T.StructField(text, T.StringType())])
    arrow = to_arrow_schema(schema)
    at = tokens.columns.index(ids)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(sent.value)
        for batch in batches:
            for part in slices(batch, pc.multiply(pc.list_value_length(batch.column(at)), 4), STEP):
                got = pa.array([None if x is None else decode_ids(x, v) for x in part.column(at).to_pylist()], pa.string())
                columns = [c.cast(f.type) for c, f in zip(part.columns, arrow, strict=False)]
                yield pa.RecordBatch.from_arrays([*columns, got.cast(arrow.field(text).type)], schema=arrow)

    return tokens.mapInArrow(scan, schema)
