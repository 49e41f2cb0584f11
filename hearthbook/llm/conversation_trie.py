"""The prefix trie of conversations, built in sorted shards around a skeleton of splitter paths.

A conversation is the path of its turns, a turn the 16-byte digest of role and text. Sorted paths are
cut into shards at splitters drawn from a sample of rows. Any node whose members lie in several shards
is a prefix of a splitter between them, so the trie of the splitter paths - the skeleton, broadcast to
all tasks - holds every such node. A shard is read once in order with a stack of open nodes and
finishes all others by itself; of skeleton nodes it gives a partial count, and the partial counts of
all shards are summed, then handed up the skeleton. Key and path are cut together, so copies of one
conversation are dealt over as many shards as they need.

Paths are taken ``span`` turns at a time: conversations that go on beyond a node at a multiple of
``span`` turns form a group, rooted there, of the next layer. One alone is a chain and needs no
sorting. No row holds more than ``span`` turns, whatever the length of a conversation, and the
skeleton has at most ``shards * (span + 1)`` nodes.

Null roles and texts are empty. Turns are ordered with null turns first; ties by role, then text, so
repeated rows are repeated turns. Rows without a key take no part. Without conversations there is no
node. Only the named columns are read; others may have any name.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from hearthbook.llm.common import word_count
from hearthbook.operators.ordering import ID_BLOCK_BITS, number_rows
from hearthbook.session import materialise

SPAN = 128
ROWS_PER_SHARD = 1_000_000
SAMPLES_PER_SHARD = 8
WIDTH = 16
PIECE = 50_000
NOTHING = hashlib.sha256(b"").hexdigest()

ROWS = "group long, path binary, conv long, words array<long>, ends boolean, kids long, leaves long, saved long, shard int"
OUT = ("kind int, shard int, no long, tid long, up_no long, up_tid long, parent long, depth long, conv long, n_convs long, "
       "n_children long, n_leaves long, saved long, words long, ends string, group long")
KINDS = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
ARROW = pa.schema([(name, KINDS[kind]) for name, kind in (part.split() for part in OUT.split(", "))])
NODE, PARTIAL, ENDS = range(3)
SHOWN = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def turn_digest(role: Column, text: Column) -> Column:
    """16 bytes of SHA-256 over role and text, the role's length first so that no two pairs read alike."""
    return F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, WIDTH)


def ordered_turns(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, pos, digest, words): every turn with its place from 0, numbered in slices of each conversation."""
    given = rows.select(F.col(key).cast("long").alias("conv"), F.col(turn).alias("turn"),
                        *[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in [(role, "role"), (text, "text")]])
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    placed = number_rows(given.filter("conv IS NOT NULL"), ["conv"], order, F.shiftright("turn", ID_BLOCK_BITS), "pos")
    return placed.select("conv", (F.col("pos") - 1).cast("long").alias("pos"), turn_digest(F.col("role"), F.col("text")).alias("digest"),
                         word_count(F.col("text")).alias("words"))


class Open:
    """A node whose members are still being read."""

    __slots__ = ("tid", "no", "conv", "n", "kids", "leaves", "saved", "words", "digest", "sha", "held", "pieces")

    def __init__(self, tid: int, no: int, words: int):
        self.tid, self.no, self.words = tid, no, words
        self.conv, self.n, self.kids, self.leaves, self.saved = None, 0, 0, 0, 0
        self.sha, self.held, self.pieces = None, [], 0


class ShardPass:
    """Reads the sorted rows of shards and yields finished nodes, partial skeleton nodes and ends."""

    def __init__(self, skeleton: dict, low: int):
        self.skeleton, self.low = skeleton, low
        self.stack: list[Open] = []
        self.shard = self.group = None
        self.path, self.count, self.out = b"", 0, []

    def ended(self, node: Open) -> str | None:
        if node.tid < 0:
            return node.sha.hexdigest() if node.sha else NOTHING
        return None

    def spill(self, node: Open) -> None:
        if node.held:
            self.out.append((ENDS, self.shard, node.pieces, node.tid, *[None] * 10, ",".join(node.held), None))
            node.held, node.pieces = [], node.pieces + 1

    def close(self, keep: int) -> None:
        """Close all but the first ``keep`` open nodes, deepest first."""
        if len(self.stack) <= keep:
            return
        closing = self.stack[keep:]
        rows = []
        for level in range(len(self.stack) - 1, keep - 1, -1):
            node, above = self.stack[level], self.stack[level - 1] if level else None
            if node.tid < 0:
                node.leaves = node.leaves if node.kids else 1
                node.saved += (node.n - 1) * node.words
            else:
                self.spill(node)
            if above:
                above.n += node.n
                above.conv = node.conv if above.conv is None else min(above.conv, node.conv)
                if node.tid < 0:
                    above.kids += 1
                    above.leaves += node.leaves
                    above.saved += node.saved
        for level, node in enumerate(closing, keep):
            above = self.stack[level - 1] if level else None
            up_no = up_tid = parent = None
            if above and above.tid >= 0:
                up_tid = above.tid
            elif above and level > keep:
                parent = above.conv
            elif above:
                up_no = above.no
            rows.append((NODE if node.tid < 0 else PARTIAL, self.shard, node.no, node.tid, up_no, up_tid, parent, self.low + level,
                         node.conv, node.n, node.kids, node.leaves, node.saved, node.words, self.ended(node), self.group))
        self.out += rows
        del self.stack[keep:]

    def push(self, mark, words: int) -> None:
        above = self.stack[-1].tid if self.stack else -1
        tid = self.skeleton.get((above, mark), -1) if above >= 0 or not self.stack else -1
        self.stack.append(Open(tid, self.count, words))
        self.count += 1

    def read(self, group, path, conv, words, ends, kids, leaves, saved, shard) -> None:
        size = len(path) // WIDTH
        if shard != self.shard or group != self.group:
            self.close(0)
            self.shard, self.group, same = shard, group, 0
            self.push(group, 0)
            self.stack[0].conv = group if self.low else None  # its smallest member may have ended in the layer above
        else:
            top = min(size, len(self.path) // WIDTH)
            same = 0
            while same < top and path[same * WIDTH:(same + 1) * WIDTH] == self.path[same * WIDTH:(same + 1) * WIDTH]:
                same += 1
            self.close(same + 1)
        for i in range(same, size):
            self.push(path[i * WIDTH:(i + 1) * WIDTH], words[i])
        self.path = path
        node = self.stack[-1]
        node.n += 1
        node.conv = conv if node.conv is None else min(node.conv, conv)
        node.kids += kids
        node.leaves += leaves
        node.saved += saved
        if ends and node.tid >= 0:
            node.held.append(str(conv))
            if len(node.held) >= PIECE:
                self.spill(node)
        elif ends:
            if node.sha is None:
                node.sha = hashlib.sha256(str(conv).encode())
            else:
                node.sha.update(b",%d" % conv)

    def drain(self) -> pa.RecordBatch:
        columns = zip(*self.out, strict=True) if self.out else [[]] * len(ARROW)
        batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ARROW, strict=True)], schema=ARROW)
        self.out = []
        return batch


def splitters(rows: DataFrame, shards: int, total: int) -> list[tuple[int, bytes, int]]:
    """At most ``shards - 1`` rows that cut a sample of about ``SAMPLES_PER_SHARD`` rows a shard evenly."""
    share = min(1.0, SAMPLES_PER_SHARD * shards / max(total, 1))
    drawn = rows.select("group", "path", "conv")
    drawn = drawn if share >= 1.0 else drawn.sample(share, seed=7)
    found = sorted((r[0], bytes(r[1]), r[2]) for r in drawn.limit(4 * SAMPLES_PER_SHARD * shards).collect())
    return sorted({found[len(found) * i // shards] for i in range(1, shards)}) if found else []


def skeleton_of(cuts: list[tuple[int, bytes, int]]) -> dict:
    """The trie of the splitter paths: (node above, digest or group) to node."""
    trie: dict = {}
    for group, path, _ in cuts:
        node = trie.setdefault((-1, group), len(trie))
        for i in range(0, len(path), WIDTH):
            node = trie.setdefault((node, path[i:i + WIDTH]), len(trie))
    return trie


def scanned(rows: DataFrame, low: int, shards: int) -> tuple[DataFrame, dict]:
    """One pass over the sorted shards, stored, and the skeleton."""
    cuts = splitters(rows, shards, rows.count())
    skeleton = skeleton_of(cuts)
    shared = rows.sparkSession.sparkContext.broadcast((cuts, skeleton))
    schema = T._parse_datatype_string(ROWS)
    arrow = to_arrow_schema(schema)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = shared.value[0]
        for b in batches:
            keys = zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([bisect_right(edges, k) for k in keys], pa.int32())], names=arrow.names)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = ShardPass(shared.value[1], low)
        for b in batches:
            for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                shard.read(*row)
                if len(shard.out) >= 20_000:
                    yield shard.drain()
        shard.close(0)
        yield shard.drain()

    names = [f.name for f in schema][:-1]
    dealt = rows.select(names).mapInArrow(mark, schema).repartitionById(shards, F.col("shard"))
    done = dealt.sortWithinPartitions("shard", "group", "path", "conv").mapInArrow(walk, OUT)
    return materialise(done, "trie"), skeleton


def digests_of_ends(pieces: DataFrame) -> DataFrame:
    """(tid, ends): the digest of each skeleton node's ends, streamed in order and never held together.

    The ends of one node are hashed one after the other, as SHA-256 asks; their shards have joined them to long strings before.
    """
    schema = T._parse_datatype_string("tid long, ends string")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sha = None, None
        for b in batches:
            done = []
            for tid, text in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), strict=True):
                if tid == at:
                    sha.update(b"," + text.encode())
                    continue
                if sha:
                    done.append((at, sha.hexdigest()))
                at, sha = tid, hashlib.sha256(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], f.type) for i, f in enumerate(arrow)], schema=arrow)
        if sha:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((at, sha.hexdigest()), arrow, strict=True)], schema=arrow)

    sorted_ = pieces.select("tid", "shard", "no", "ends").repartition("tid").sortWithinPartitions("tid", "shard", "no")
    return sorted_.mapInArrow(run, schema)


def reduced(found: DataFrame, skeleton: dict) -> DataFrame:
    """Skeleton nodes from the partial counts of all shards; sums travel up the skeleton once."""
    above = {node: up for (up, _), node in skeleton.items()}
    shared = found.sparkSession.sparkContext.broadcast(above)
    part = found.filter(F.col("kind") == PARTIAL).groupBy("tid").agg(
        F.first("up_tid").alias("up_tid"), F.first("depth").alias("depth"), F.first("group").alias("group"), F.min("conv").alias("conv"),
        *[F.sum(c).alias(c) for c in ["n_convs", "n_children", "n_leaves", "saved"]], F.max("words").alias("words"))
    part = materialise(part, "skeleton")
    kids = part.filter("up_tid IS NOT NULL").groupBy(F.col("up_tid").alias("tid")).agg(F.count("*").alias("inner_kids"))
    part = part.join(kids, "tid", "left").withColumn("n_children", F.col("n_children") + F.coalesce("inner_kids", F.lit(0)))
    schema = T._parse_datatype_string("tid long, n_leaves long, saved long")

    def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for tid, leaves, saved in zip(*[c.to_pylist() for c in b.columns], strict=True):
                while tid >= 0:
                    out.append((tid, leaves, saved))
                    tid = shared.value[tid]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], names=["tid", "n_leaves", "saved"])

    own = part.select("tid", F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_leaves")).cast("long"),
                      (F.col("saved") + (F.col("n_convs") - 1) * F.col("words")).cast("long"))
    sums = own.mapInArrow(climb, schema).groupBy("tid").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
    ends = digests_of_ends(found.filter(F.col("kind") == ENDS))
    out = part.drop("n_leaves", "saved", "words", "inner_kids").join(sums, "tid").join(ends, "tid", "left")
    out = out.withColumn("ends", F.coalesce("ends", F.lit(NOTHING)))
    names = out.select(F.col("tid").alias("up_tid"), F.col("conv").alias("parent"))
    return materialise(out.join(names, "up_tid", "left"), "skeleton")


def layer(alive: DataFrame, turns: DataFrame, number: int, span: int, shards: int | None) -> tuple[DataFrame, DataFrame]:
    """Nodes below the groups of ``alive`` (conv, n, group), and (conv, kids, leaves, saved) of each group's root."""
    low = number * span
    spark = alive.sparkSession
    here = turns.filter((F.col("pos") >= low) & (F.col("pos") < low + span))
    listed = F.sort_array(F.collect_list(F.struct("pos", F.hex("digest").alias("digest"), "words")))
    here = here.groupBy("conv").agg(listed.alias("t")).select(
        "conv", F.unhex(F.array_join(F.transform("t", lambda t: t["digest"]), "")).alias("path"), F.transform("t", lambda t: t["words"]).alias("words"))
    rows = alive.join(here, "conv", "left").select(
        "group", F.coalesce("path", F.lit(b"")).alias("path"), "conv", F.coalesce("words", F.array().cast("array<long>")).alias("words"), "n",
        (F.col("n") <= low + span).alias("ends"))
    rows = materialise(rows, "paths")
    zero = [F.lit(0).cast("long").alias(c) for c in ("kids", "leaves", "saved")]
    more, deeper, roots = rows.filter(~F.col("ends")), [], None
    if not more.isEmpty():
        heads = rows.groupBy("group", "path").agg(F.min("conv").alias("next"), F.count_if(~F.col("ends")).alias("members"))
        met = materialise(more.join(heads, ["group", "path"]).select("conv", "n", "next", "members"), "groups")
        alone = met.filter("members = 1").select("conv", "n", "next")
        tail = alone.join(turns.filter(F.col("pos") >= low + span).select("conv", "pos"), "conv")
        above = F.when(F.col("pos") == low + span, F.col("next")).otherwise(F.col("conv"))
        last = F.col("pos") + 1 == F.col("n")
        deeper.append(tail.select(
            F.col("conv").alias("conv_id"), (F.col("pos") + 1).alias("depth"), above.alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"),
            F.when(last, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
            F.when(last, F.sha2(F.col("conv").cast("string"), 256)).otherwise(NOTHING).alias("ends_sha256")))
        roots = alone.select(F.col("next").alias("conv"), F.lit(1).cast("long").alias("kids"), F.lit(1).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"))
        together = met.filter("members > 1").select("conv", "n", F.col("next").alias("group"))
        if not together.isEmpty():
            nodes, tops = layer(together, turns, number + 1, span, shards)
            deeper.append(nodes)
            roots = roots.unionByName(tops)
        rows = rows.join(roots, "conv", "left").fillna(0, ["kids", "leaves", "saved"])
    else:
        rows = rows.select("*", *zero)
    count = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // ROWS_PER_SHARD))
    found, skeleton = scanned(rows, low, count)
    inner = reduced(found, skeleton)
    local = found.filter(F.col("kind") == NODE)
    # nodes below the skeleton find their parent in it: at most shards * (span + 1) rows of two numbers
    tops = F.broadcast(inner.select(F.col("tid").alias("up_tid"), F.col("conv").alias("tid_conv")))
    opened = local.select("shard", F.col("no").alias("up_no"), F.col("conv").alias("no_conv"))
    # children of a node that was still open: one row for each time that the sorted paths part, a shard's rows at most below one node
    waiting = local.filter("up_no IS NOT NULL").join(opened, ["shard", "up_no"]).withColumn("parent", F.col("no_conv"))
    under = local.filter("up_tid IS NOT NULL").join(tops, "up_tid").withColumn("parent", F.col("tid_conv"))
    settled = local.filter("up_no IS NULL AND up_tid IS NULL")
    kept = ["conv", "depth", "parent", "n_convs", "n_children", "n_leaves", "saved", "ends", "group"]
    nodes = settled.select(kept).unionByName(under.select(kept)).unionByName(waiting.select(kept)).unionByName(inner.select(kept))
    tops = nodes.filter(F.col("depth") == low).select(F.col("group").alias("conv"), F.col("n_children").alias("kids"), F.col("n_leaves").alias("leaves"), "saved")
    if number:
        nodes = nodes.filter(F.col("depth") > low)
    shown = nodes.select(*[F.col(a).alias(b) for a, b in zip(kept, SHOWN)])
    for d in deeper:
        shown = shown.unionByName(d)
    return shown, tops


def prefix_trie(convs: DataFrame, turns: DataFrame, span: int = SPAN, shards: int | None = None) -> DataFrame:
    """All nodes of the trie of ``convs`` (conv, n) with ``turns`` (conv, pos, digest, words), pos from 0 to n - 1.

    A node's conv_id is its smallest member; with the depth it names the node. Members, children, leaves
    below, tokens saved by sharing prefixes, and the digest of the conversations that end there.
    """
    alive = convs.select("conv", "n", F.lit(0).cast("long").alias("group"))
    return layer(alive, turns, 0, span, shards)[0]
