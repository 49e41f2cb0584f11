"""Log-likelihoods of whole documents under a recurrent language model learned from the corpus.

Words are runs without ASCII blanks, A to Z in lower case; every text is closed by one end. Words are
counted over all training documents. The ``vocab`` most frequent ones and the end are words of a gated
recurrent network (``gru.py``), all others one word there; which of the others it is follows their
counts or, with the Good-Turing share of words seen once, their spelling (byte triples of all different
words). The product is a proper distribution over texts.

The network learns from every training document once: documents are dealt into ``rates`` rounds by
hash; in a round each task goes on from the common weights over its own share, and the weights are
averaged by words seen. Weights, the ``head`` most frequent words and the table of byte triples are all
that is broadcast or comes to the driver; each has a fixed bound. Words beyond the head are joined with
their counts, each once per document.

Null texts are empty and hold the end alone. A null key reads as ''. Repeated rows count and score each.
Without training documents counts are 0 and the network is untrained. Only key and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from hearthbook.llm import gru
from hearthbook.llm.common import release, slices
from hearthbook.session import materialise

VOCAB = 1024
HEAD = 131_072
HIDDEN = 16
EMBED = 8
RATES = (0.01, 0.005, 0.002)
CHUNK = 2_000_000
SLICE = 2 << 20  # bytes of text that a task takes up at once; a longer text comes whole
BLOCK = 4096
CONTEXTS = 16_381
LEAN = 3.0
BYTES = 257  # 256 marks the start of a word as context and its end as what follows

PAIRS = BYTES * BYTES


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts one after the other, and the number of words of each."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat, sizes = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    full = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if full.all():
        return flat, sizes
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return flat.filter(pa.array(full)), np.bincount(owner[full], minlength=len(sizes))


def held_out(key: str, folds: int) -> Column:
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % folds == 0


def word_counts(train: DataFrame, text: str) -> DataFrame:
    """(token, c): how often each word stands in the training texts; the end under null."""
    schema = pa.schema([("token", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, pc.binary_length(whole.column(0)), 4 * SLICE)):
            found = pc.value_counts(words_of(pc.fill_null(batch.column(0), ""))[0])
            yield pa.RecordBatch.from_arrays([found.field(0), found.field(1)], schema=schema)
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([batch.num_rows], pa.int64())], schema=schema)

    return train.select(text).mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("c")).filter("c > 0")


def byte_codes(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte pairs and byte triples of each word, start and end included, as codes, and where each word's begin.

    A triple's two leading bytes are told apart as one of ``CONTEXTS`` remainders.
    """
    raw = words.cast(pa.binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset:raw.offset + len(raw) + 1].astype(np.int64)
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]].astype(np.int64)
    sizes = np.diff(offsets)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]).astype(np.int64)
    # one place more than bytes for each word: from (start, first byte) to (last byte, end)
    places = np.arange(len(data)) + np.repeat(np.arange(len(sizes)), sizes)
    total = len(data) + len(sizes)
    after, before, sooner = (np.full(total + 1, 256, np.int64) for _ in range(3))
    after[places] = data
    before[places + 1] = data
    # two bytes back: what was one byte back a place before, but for the first place of a word
    sooner[1:] = before[:-1]
    sooner[starts] = 256
    after, before, sooner = after[:total], before[:total], sooner[:total]
    return before * BYTES + after, (sooner * BYTES + before) % CONTEXTS * BYTES + after, starts


def spelling_counts(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(codes, counts) of byte pairs, and of triples from ``PAIRS`` on, over all different words: a bounded number of codes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(PAIRS + CONTEXTS * BYTES, np.int32)
        for batch in batches:
            if batch.num_rows:
                pairs, triples, _ = byte_codes(batch.column(0))
                np.add.at(total, np.concatenate([pairs, triples + PAIRS]), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at].astype(np.int64))], names=["code", "n"])

    found = counts.filter("token IS NOT NULL").select("token").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    return found["code"].to_numpy().astype(np.int64), found["n"].to_numpy().astype(np.float64)


class Lexicon:
    """What the tasks know of the corpus: the head of the vocabulary, totals, and how words are spelled."""

    def __init__(self, head: list[tuple[str, int]], ends: int, total: int, kinds: int, once: int, codes: tuple[np.ndarray, np.ndarray], vocab: int, least: int):
        self.words, self.counts = [w for w, _ in head], np.array([c for _, c in head], np.float64)
        self.vocab = min(vocab - 2, len(head))
        self.ends, self.total, self.kinds, self.least = ends, total, kinds, least
        self.floor = total + 0.1 * (kinds + 1)
        self.tail = total - ends - float(self.counts[:self.vocab].sum())
        # the share of words never seen, after Good and Turing; all of it where nothing was counted
        self.new = min(0.99, max(0.01, once / self.tail)) if self.tail > 0 else 1.0
        self.codes = codes

    def network_counts(self) -> np.ndarray:
        return np.concatenate([[self.ends, self.tail], self.counts[:self.vocab]])

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / self.floor)

    def spelled(self, words: pa.Array) -> np.ndarray:
        """log10 probability of the letters of each word."""
        if not len(words):
            return np.zeros(0)
        pairs, triples, starts = byte_codes(words)
        # what followed two bytes, leaning on what followed the last of them
        p = (self.triples[triples] + LEAN * self.pairs[pairs]) / (self.contexts[triples // BYTES] + LEAN)
        return np.add.reduceat(np.log10(p), starts)

    def ready(self) -> None:
        """Tables of spelling and of the head, built once in each task."""
        codes, counts = self.codes
        low = codes < PAIRS
        pairs, self.triples = np.full(PAIRS, 0.05), np.zeros(CONTEXTS * BYTES, np.float32)
        pairs[codes[low]] += counts[low]
        self.triples[codes[~low] - PAIRS] = counts[~low]
        self.pairs = (pairs.reshape(BYTES, BYTES) / pairs.reshape(BYTES, BYTES).sum(1, keepdims=True)).ravel()
        self.contexts = self.triples.reshape(CONTEXTS, BYTES).sum(1)
        self.lookup = pa.array(self.words, pa.string())
        rest = self.counts[self.vocab:]
        by_letters = self.new * 10.0 ** self.spelled(self.lookup[self.vocab:])
        self.in_tail = np.log10((1 - self.new) * rest / self.tail + by_letters) if self.tail > 0 else np.log10(by_letters)

    def ids(self, words: pa.Array) -> np.ndarray:
        """Place of each word in the head; -1 beyond it."""
        return pc.fill_null(pc.index_in(words, value_set=self.lookup), -1).to_numpy(zero_copy_only=False).astype(np.int32)

    def network_ids(self, places: np.ndarray) -> np.ndarray:
        return np.where((places >= 0) & (places < self.vocab), places + 2, gru.OTHER).astype(np.int32)


def network_texts(lexicon: Lexicon, places: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Network ids of every text, each closed by the end."""
    stops = np.cumsum(sizes)
    closed = np.insert(lexicon.network_ids(places), stops, gru.END)
    return np.split(closed, stops[:-1] + np.arange(1, len(sizes))) if len(sizes) else []


def gathered(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
    """(first column, words, sizes) of about ``CHUNK`` words, so that enough texts run side by side; a longer text comes whole."""
    # large arrays go back to the system at once, what lies between smaller ones after every chunk
    pool = pa.system_memory_pool()
    pa.set_memory_pool(pool)
    first, words, sizes, held = [], [], [], 0

    def taken() -> tuple[pa.Array, pa.Array, np.ndarray]:
        whole = pa.concat_arrays(first), pa.concat_arrays(words), np.concatenate(sizes)
        for parts in (first, words, sizes):
            parts.clear()
        return whole

    for batch in (part for whole in batches for part in slices(whole, pc.binary_length(whole.column(text)), SLICE)):
        found, counts = words_of(pc.fill_null(batch.column(text), ""))
        first.append(batch.column(0))
        words.append(found)
        sizes.append(counts)
        held += len(found)
        if held >= CHUNK:
            held = 0
            yield taken()
            pool.release_unused()
    if first:
        yield taken()
    pool.release_unused()


def learned(counts: DataFrame, head: int, vocab: int) -> Lexicon:
    """The lexicon of stored counts; the head is all words from some count on, at most ``head`` of them."""
    step = F.floor(F.log2("c") * 8)
    bins = counts.filter("token IS NOT NULL").groupBy(step.alias("bin")).agg(
        F.count("*").alias("kinds"), F.min("c").alias("least"), F.sum("c").alias("words"), F.count_if(F.col("c") == 1).alias("once")).collect()
    ends = counts.filter("token IS NULL").select("c").first()
    ends = ends[0] if ends else 0
    least, room = None, head
    for b in sorted(bins, key=lambda b: -b["bin"]):
        room -= b["kinds"]
        if room < 0:
            break
        least = b["least"]
    top = [] if least is None else counts.filter((F.col("c") >= least) & F.col("token").isNotNull()).collect()
    top = sorted(((r["token"], r["c"]) for r in top), key=lambda x: (-x[1], x[0].encode()))
    return Lexicon(top, ends, ends + sum(b["words"] for b in bins), (ends > 0) + sum(b["kinds"] for b in bins), sum(b["once"] for b in bins),
                   spelling_counts(counts), vocab, least if least is not None else 1 << 62)


def averaged(train: DataFrame, text: str, lexicon: Lexicon, shape: gru.Shape, flat: np.ndarray, rate: float, trainers: int) -> np.ndarray:
    """The weights after one round: each task learns from its texts, the mean is by words seen."""
    shared = train.sparkSession.sparkContext.broadcast((lexicon, shape, flat))
    schema = T._parse_datatype_string("block int, part array<float>, seen long")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, form, weights = shared.value
        known.ready()
        # a map holds no chunk while the next step works
        chunks = map(lambda chunk: network_texts(known, known.ids(chunk[1]), chunk[2]), gathered(batches, 0))
        new, seen = gru.train(weights, form, chunks, rate)
        if seen:
            blocks = [new[i:i + BLOCK] for i in range(0, len(new), BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array(blocks, arrow.field(1).type),
                                              pa.array([seen] * len(blocks), pa.int64())], schema=arrow)

    # few tasks read many splits each: the weights that are shuffled grow with the cluster, not with the corpus
    told = train.select(text).coalesce(trainers).mapInArrow(run, schema).select("block", "seen", F.posexplode("part").alias("pos", "v"))
    mean = told.groupBy("block", "pos").agg((F.sum(F.col("v").cast("double") * F.col("seen")) / F.sum("seen")).alias("v")).toArrow()
    if not mean.num_rows:
        return flat
    new = flat.copy()
    at = mean["block"].to_numpy().astype(np.int64) * BLOCK + mean["pos"].to_numpy()
    new[at] = mean["v"].to_numpy()
    return new


def fitted(train: DataFrame, key: str, text: str, lexicon: Lexicon, rates: tuple[float, ...], hidden: int, embed: int) -> tuple[gru.Shape, np.ndarray]:
    counts = lexicon.network_counts()
    shape = gru.Shape(len(counts), embed, hidden, gru.class_edges(counts, int(np.sqrt(len(counts)))))
    flat = gru.fresh(shape, counts)
    trainers = 2 * train.sparkSession.sparkContext.defaultParallelism
    for i, rate in enumerate(rates):
        share = train.filter(F.pmod(F.xxhash64(key, text), F.lit(len(rates))) == i)
        flat = averaged(share, text, lexicon, shape, flat, rate, trainers)
    return shape, flat


def in_head(docs: DataFrame, key: str, text: str, lexicon: Lexicon, shape: gru.Shape, flat: np.ndarray) -> DataFrame:
    """(k, n_tokens, n_known, base, score, rare): scores of all words of the head, and the words beyond it with their letters' log10 probability."""
    shared = docs.sparkSession.sparkContext.broadcast((lexicon, shape, flat))
    kind = docs.schema[key].dataType.simpleString()
    schema = T._parse_datatype_string(f"k {kind}, n_tokens long, n_known long, base double, score double, rare array<struct<token:string,n:bigint,spelled:double>>")
    arrow = to_arrow_schema(schema)
    item = pa.struct([("token", pa.string()), ("n", pa.int64()), ("spelled", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, form, weights = shared.value
        known.ready()
        net = gru.Net(weights, form)
        base, end = known.base(known.counts), float(known.base(np.array([known.ends]))[0])

        def scored(keys: pa.Array, words: pa.Array, sizes: np.ndarray) -> pa.RecordBatch:
            docs_, places = len(sizes), known.ids(words)
            owner = np.repeat(np.arange(docs_), sizes)
            seen = places >= 0
            score = net.score(network_texts(known, places, sizes)) / np.log(10)
            tail = places >= known.vocab
            score += np.bincount(owner[tail], known.in_tail[places[tail] - known.vocab], docs_)
            based = end + np.bincount(owner[seen], base[places[seen]], docs_)
            held = np.bincount(owner[seen], minlength=docs_) + (known.ends > 0)
            rare = pa.table({"doc": pa.array(owner[~seen]), "token": words.filter(pa.array(~seen))}).group_by(["doc", "token"]).aggregate([([], "count_all")])
            rare = rare.sort_by("doc").combine_chunks()
            tokens = rare["token"].combine_chunks() if rare.num_rows else pa.array([], pa.string())
            tokens = tokens.chunk(0) if isinstance(tokens, pa.ChunkedArray) else tokens
            offsets = np.searchsorted(rare["doc"].to_numpy(), np.arange(docs_ + 1))
            fields = [tokens, pa.array(rare["count_all"].to_numpy(), pa.int64()), pa.array(known.spelled(tokens))]
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(item)))
            return pa.RecordBatch.from_arrays([keys.cast(arrow.field(0).type), pa.array(sizes + 1, pa.int64()), pa.array(held, pa.int64()), pa.array(based), pa.array(score),
                                               lists.cast(arrow.field(5).type)], schema=arrow)

        yield from map(lambda chunk: scored(*chunk), gathered(batches, 1))

    return docs.select(docs[key].alias("k"), docs[text].alias("t")).mapInArrow(run, schema)


def lm_scores(docs: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 10, vocab: int = VOCAB, head: int = HEAD,
              hidden: int = HIDDEN, embed: int = EMBED, rates: tuple[float, ...] = RATES) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score): log10 probabilities of every text.

    One document in ``folds`` by the CRC-32 of its key is held out of counting and learning. ``base_score``
    adds up smoothed word frequencies, ``score`` is the network's.
    """
    spark = docs.sparkSession
    train = docs.filter(~held_out(key, folds))
    counts = materialise(word_counts(train, text), "counts")
    lexicon = learned(counts, head, vocab)
    shape, flat = fitted(train, key, text, lexicon, rates, hidden, embed)
    release(spark)
    scored = in_head(docs, key, text, lexicon, shape, flat).withColumn("row", F.monotonically_increasing_id())
    scored = materialise(scored, "scored")
    rare = scored.select("row", F.inline("rare"))
    met = rare.join(counts.filter(F.col("c") < lexicon.least), "token", "left").withColumn("c", F.coalesce("c", F.lit(0)).cast("double"))
    letters = lexicon.new * F.pow(F.lit(10.0), F.col("spelled"))
    counted = (1 - lexicon.new) / lexicon.tail * F.col("c") if lexicon.tail > 0 else F.lit(0.0)
    sums = met.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("known"),
        F.sum(F.col("n") * F.log10((F.col("c") + 0.1) / lexicon.floor)).alias("b"),
        F.sum(F.col("n") * F.log10(counted + letters)).alias("s"))
    out = scored.join(sums, "row", "left")
    zero = F.lit(0)
    return out.select(F.col("k").alias(key), held_out("k", folds).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("known", zero)).alias("n_known"),
                      F.lit(lexicon.total).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("b", zero)).alias("base_score"),
                      (F.col("score") + F.coalesce("s", zero)).alias("score"))
