"""Mixing sources to target weights.

Every source has a word target. Its documents, in a random order, are a stream of blocks; the mix takes
the stream as often as the target allows and cuts the last pass at the target's word, so quotas are
exact. A splitting tree deals the blocks out: at each node the quotas of all sources are parted between
two halves of the output shards by a multivariate hypergeometric draw, down to single shards. What a
shard is due of a source is then a stretch of the source's own block order: shards share no block, and a
shard's documents are shuffled by themselves. All draws follow from the seed, so reruns agree.

Targets: sources by code point, null last, weigh 1, 2, 3, repeating; they share ``share`` of all words,
a target ends at ``passes`` times its source's size, and the excess is shared again by weight.

Null and blank texts have size 0 and are not taken. Rows repeated with key, source and text are taken
alike. Null keys are keys. Columns beside key, source and text are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from hearthbook.llm.common import GAP, WORD, keeps_names, running, word_count
from hearthbook.session import materialise

MAX_DRAWS = 500_000_000  # numpy draws hypergeometric numbers from populations below 10^9


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, passes: int = 3) -> DataFrame:
    """(source, source_size, source_no, target) from (source, source_size); any number of sources."""
    no_null = F.col("source").isNull()
    numbered = running(sizes, [no_null.asc(), F.col("source").asc()], {}, "source_no")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    numbered = numbered.withColumn("weight", weight).withColumn("ratio", F.col("source_size") / F.col("weight"))
    filled = running(numbered, [F.col("ratio").asc(), F.col("source_no").asc()],
                     {"upto_size": "source_size", "upto_weight": "weight"}, "filling")
    total = numbered.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("total"), F.sum("weight").alias("all_weight"))
    filled = filled.join(F.broadcast(total))  # one row
    # the level at which water stands once every fuller source is capped: a source is capped if it lies below it
    wanted = F.col("total") * share
    level = (wanted - passes * (F.col("upto_size") - F.col("source_size"))) / (F.col("all_weight") - F.col("upto_weight") + F.col("weight"))
    filled = materialise(filled.withColumn("capped", passes * F.col("ratio") < level), "filled")
    left = filled.agg(F.coalesce(F.sum(F.when(F.col("capped"), F.col("source_size"))), F.lit(0)).alias("capped_size"),
                      F.coalesce(F.sum(F.when(F.col("capped"), F.col("weight"))), F.lit(0.0)).alias("capped_weight"))
    level = (wanted - passes * F.col("capped_size")) / (F.col("all_weight") - F.col("capped_weight"))
    target = F.when(F.col("capped"), (passes * F.col("source_size")).cast("double")).otherwise(
        F.least(F.col("weight") * level, (passes * F.col("source_size")).cast("double")))
    return filled.join(F.broadcast(left)).select("source", "source_size", "source_no", F.coalesce(target, F.lit(0.0)).alias("target"))


def split_quotas(quotas: np.ndarray, shards: int, seed: int, chunk: int) -> np.ndarray:
    """Blocks of each source for each shard, (shards, sources); rows sum to even shares, columns to the quotas."""
    total = int(quotas.sum())
    share = np.full(shards, total // shards, np.int64)
    share[:total % shards] += 1
    out = np.zeros((shards, len(quotas)), np.int64)
    open_nodes = [(0, shards, quotas.astype(np.int64))]
    while open_nodes:
        lo, hi, held = open_nodes.pop()
        if hi - lo == 1:
            out[lo] = held
            continue
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, chunk, lo, hi])
        need, rest = int(share[lo:mid].sum()), int(held.sum())
        left = np.zeros_like(held)
        for s, n in enumerate(held.tolist()):  # one marginal after the other
            rest -= n
            left[s] = rng.hypergeometric(n, rest, need) if n and need else 0
            need -= int(left[s])
        open_nodes += [(lo, mid, left), (mid, hi, held - left)]
    return out


def deal(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(source_no, draw, shard) for every draw of every source; a tree for each 1,024 sources."""
    def chunk(key: tuple, batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("source_no")
        due = split_quotas(batch["draws"].to_numpy(), shards, seed, int(key[0]))
        begin = np.cumsum(due, axis=0) - due
        shard, source = np.nonzero(due)
        return pd.DataFrame({"source_no": batch["source_no"].to_numpy()[source], "shard": shard,
                             "begin": begin[shard, source], "n": due[shard, source]})

    parts = quotas.select("source_no", "draws", (F.col("source_no") / 1024).cast("long").alias("chunk"))
    stretches = parts.groupBy("chunk").applyInPandas(chunk, "source_no long, shard long, begin long, n long")
    return stretches.select("source_no", "shard", F.explode(F.sequence("begin", F.col("begin") + F.col("n") - 1)).alias("draw"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", shards: int = 64,
        block_words: int = 1 << 15, seed: int = 17, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0,
        passes: int = 3) -> DataFrame:
    """Documents with what the mix takes of each.

    One row for equal rows, with their number in ``copies``; figures are of each.
    Columns: the key, mark (hash of the text), source, size, copies, source_size, target, draws
    array<struct<shard, place, words>> and taken. A draw takes the document's first ``words`` words into
    ``shard``, where rows go by ``place``; it is whole but for the one document where a source's target ends.
    """
    rows = docs.select(F.col(key).alias("k"), F.col(source).alias("source"), F.xxhash64(text).alias("mark"),
                       word_count(F.col(text)).alias("size"))
    units = materialise(rows.groupBy("k", "source", "mark", "size").agg(F.count("*").alias("copies")), "units")
    sizes = units.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    aims = source_targets(sizes, weights, share, passes)
    quota = F.round("target").cast("long")
    has = F.col("source_size") > 0
    # blocks hold about block_words words, more where that would make too many draws
    total = sizes.agg(F.sum("source_size").alias("all_words"))
    per = F.greatest(F.lit(float(block_words)), F.coalesce("all_words", F.lit(0)) * float(passes) / MAX_DRAWS)
    aims = aims.join(F.broadcast(total)).withColumns({
        "blocks": F.greatest(F.ceil(F.col("source_size") / per), F.lit(1)).cast("long"),
        "whole": F.when(has, F.floor(quota / F.col("source_size"))).otherwise(0).cast("long"),
        "rest": F.when(has, quota % F.col("source_size")).otherwise(0).cast("long")}).drop("all_words")
    aims = materialise(aims, "aims")

    drawn = F.xxhash64("k", "mark", F.lit(seed))
    units = units.join(aims, units["source"].eqNullSafe(aims["source"])).drop(aims["source"])
    units = units.withColumn("order", drawn).withColumn("block", F.pmod("order", "blocks"))
    words = F.col("size") * F.col("copies")
    blocks = units.groupBy("source_no", "block").agg(F.sum(words).alias("block_words"))
    blocks = blocks.withColumn("slab", (F.col("block") / 1024).cast("long"))
    slabs = blocks.groupBy("source_no", "slab").agg(F.sum("block_words").alias("slab_words"))
    before = Window.partitionBy("source_no").orderBy("slab").rowsBetween(Window.unboundedPreceding, -1)
    slabs = slabs.select("source_no", "slab", F.coalesce(F.sum("slab_words").over(before), F.lit(0)).alias("slab_start"))
    before = Window.partitionBy("source_no", "slab").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.join(slabs, ["source_no", "slab"]).select(
        "source_no", "block", (F.col("slab_start") + F.coalesce(F.sum("block_words").over(before), F.lit(0))).alias("block_start"))
    blocks = materialise(blocks, "blocks")
    inside = Window.partitionBy("source_no", "block").orderBy("order", "k", "mark").rowsBetween(Window.unboundedPreceding, -1)
    units = units.join(blocks, ["source_no", "block"])
    units = units.withColumn("start", F.col("block_start") + F.coalesce(F.sum(words).over(inside), F.lit(0)))
    # of the last pass, in words of one copy
    last = F.floor(F.greatest(F.lit(0), F.least(words, F.col("rest") - F.col("start"))) / F.col("copies")).cast("long")
    units = units.withColumn("last", last)

    last_block = blocks.join(aims.select("source_no", "rest"), "source_no").filter(F.col("block_start") < F.col("rest"))
    last_block = last_block.groupBy("source_no").agg((F.max("block") + 1).alias("cut"))
    quotas = aims.join(last_block, "source_no", "left").select(
        "source_no", (F.col("whole") * F.col("blocks") + F.coalesce("cut", F.lit(0))).alias("draws")).filter("draws > 0")
    turns = F.when(F.col("whole") > 0, F.sequence(F.lit(1), F.col("whole"))).otherwise(F.array().cast("array<bigint>"))
    turns = F.transform(turns, lambda p: F.struct((p - 1).alias("pass"), F.col("size").alias("words")))
    end = F.when(F.col("last") > 0, F.array(F.struct(F.col("whole").alias("pass"), F.col("last").alias("words")))).otherwise(
        F.array().cast("array<struct<pass:bigint,words:bigint>>"))
    units = materialise(units.withColumn("turns", F.concat(turns, end)).select(
        "k", "mark", "source", "size", "copies", "source_size", "target", "source_no", "blocks", "block", "order", "turns"), "dealt")
    each = units.filter("size > 0").select(
        "k", "mark", "source", "source_no", "order", "blocks", "block", F.explode("turns").alias("t"))
    each = each.withColumn("draw", F.col("t.pass") * F.col("blocks") + F.col("block"))
    each = each.join(deal(quotas, shards, seed), ["source_no", "draw"])
    place = F.xxhash64("order", "k", "shard", F.lit(seed))
    taken = each.groupBy("k", "mark", "source_no").agg(
        F.sum("t.words").alias("taken"), F.collect_list(F.struct("shard", place.alias("place"), F.col("t.words").alias("words"))).alias("draws"))
    out = units.alias("u").join(
        taken.alias("t"), F.col("u.k").eqNullSafe(F.col("t.k")) & (F.col("u.mark") == F.col("t.mark")) & (F.col("u.source_no") == F.col("t.source_no")), "left")
    return out.select(F.col("u.k").alias(key), F.col("u.mark").alias("mark"), F.col("u.source").alias("source"), "size",
                      "copies", "source_size", "target", F.coalesce("draws", F.array().cast(DRAWS)).alias("draws"),
                      F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


DRAWS = "array<struct<shard:bigint,place:bigint,words:bigint>>"


@keeps_names
def mixed_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix itself: each document as often as it is drawn, by shard, in each shard's own random order.

    The one document where a source's target ends gives its first words; documents without words are not drawn.
    """
    drawn = mix(docs, key, text, source, **options).select(
        F.col(key).alias("_k"), F.col("mark").alias("_m"), F.col("source").alias("_s"), F.col("size").alias("_size"), F.col("draws").alias("_draws"))
    rows = docs.withColumn("_m", F.xxhash64(text))
    on = rows[key].eqNullSafe(drawn["_k"]) & (rows["_m"] == drawn["_m"]) & rows[source].eqNullSafe(drawn["_s"])
    rows = rows.join(drawn.filter(F.size("_draws") > 0), on).withColumn("_d", F.explode("_draws"))
    worded = F.regexp_extract_all(F.col(text), F.lit(f"({GAP}*{WORD})"), F.lit(1))
    head = F.array_join(F.slice(worded, F.lit(1), F.col("_d.words").cast("int")), "")
    rows = rows.withColumn(text, F.when(F.col("_d.words") == F.col("_size"), F.col(text)).otherwise(head))
    rows = rows.repartition(F.col("_d.shard")).sortWithinPartitions("_d.shard", "_d.place")
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])
