"""How far the sources of a language diverge in their words.

Duplicate texts collapse first: identical texts of a language (128 bits of hash) are one text with a
multiplicity per source. A task of the scan hands on each text once, all copies of a text meet in one
place, it is tokenized once there, and its terms count as often as it stands in each source. Terms in at
least ``min_docs`` documents of the language are kept. With count c of a term, N terms in all and V
kept terms, p = 1 + floor(10^9 (c + 1) / (N + V)); the divergence of p from q is floor((p - q)^2 / q),
in integers throughout.

Pairs of sources are evaluated sparsely. Where neither source has a term the value is the same for
all such terms, so a pair's sum is V times that value plus corrections at the terms that one of the
two has. Terms are dealt in slices of about ``SLICE_ROWS`` rows, sources in blocks of about
``BLOCK_SOURCES``; a task takes one slice of one pair of blocks and returns one correction per pair.
Neither a language nor a source meets in one task.

Null texts, languages and sources are ''. Repeated rows count each. A language without kept terms has
V = 0 and pairs of value 0. Ties are ranked by the item. Only the three named columns are read.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from hearthbook.llm.common import release
from hearthbook.session import materialise

MIN_DOCS = 3
SCALE = 1_000_000_000
SLICE_ROWS = 50_000
BLOCK_SOURCES = 128
TOP_TERMS = 200
HELD_TERMS = 400_000
TERM = re.compile(rb"[a-z\x80-\xff]+")


def smoothed(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 1) / (total + terms)); decimal, so that no count overflows."""
    top = (count.cast("decimal(20,0)") + F.lit(1).cast("decimal(1,0)")) * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", top, (total + terms).cast("decimal(20,0)")) + 1


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def collapsed(rows: DataFrame) -> DataFrame:
    """(lang, mark, source, copies, text): the copies of each text in each task of the scan; a task hands on a text once."""
    schema = T._parse_datatype_string("lang string, mark binary, source string, copies long, text string")
    arrow = to_arrow_schema(schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            copies, texts = Counter(), {}
            for lang, source, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                key = (lang, hashlib.md5(text.encode("utf-8", "surrogatepass")).digest())
                copies[(*key, source)] += 1
                if key not in seen:
                    seen.add(key)
                    texts[(*key, source)] = text
            rows = [(*k, n, texts.get(k)) for k, n in copies.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)], schema=arrow)

    return rows.mapInArrow(scan, schema)


def term_rows(copies: DataFrame) -> DataFrame:
    """(lang, term, source, n, docs): weighted counts and document frequencies, added up over many texts before they leave a task."""
    schema = T._parse_datatype_string("lang string, term string, source string, n long, docs long")
    arrow = to_arrow_schema(schema)

    def drained(held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (counts, docs) in held.items():
            terms = pa.array(list(counts), pa.binary()).cast(pa.string())
            of = [pa.array([v] * len(counts), pa.string()) for v in (lang, source)]
            numbers = [pa.array(list(counts.values()), pa.int64()), pa.array([docs[t] for t in counts], pa.int64())]
            yield pa.RecordBatch.from_arrays([of[0], terms, of[1], *numbers], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        at, words, kinds, size = None, [], set(), 0
        for batch in batches:
            for lang, mark, source, copies, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (lang, mark) != at:
                    # the first row of a text brings the text; letters, digits and marks of ASCII are single bytes, so runs of bytes are runs of characters
                    at, words = (lang, mark), TERM.findall(text.encode("utf-8", "surrogatepass").lower())
                    kinds = set(words)
                counts, docs = held.setdefault((lang, source), (Counter(), Counter()))
                size -= len(docs)
                if copies == 1:
                    counts.update(words)
                    docs.update(kinds)
                else:
                    for t, n in Counter(words).items():
                        counts[t] += n * copies
                        docs[t] += copies
                size += len(docs)
                if size > HELD_TERMS:
                    yield from drained(held)
                    held, size = {}, 0
        yield from drained(held)

    ordered = copies.repartition("lang", "mark").sortWithinPartitions("lang", "mark", F.col("text").isNull())
    return ordered.mapInArrow(run, schema)


def counted(docs: DataFrame, lang: str, source: str, text: str, min_docs: int) -> tuple[DataFrame, DataFrame]:
    """Groups (lang, source), and the kept terms (lang, source, term, n, all_n): counts in the group and in the language."""
    rows = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in [(lang, "lang"), (source, "source"), (text, "text")]])
    everywhere = Window.partitionBy("lang", "term")
    # dealt by term before they are added up: counts of a group and of the language then need no further shuffle
    terms = term_rows(collapsed(rows)).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = terms.select("lang", "source", "term", "n", F.sum("n").over(everywhere).alias("all_n"), F.sum("docs").over(everywhere).alias("all_docs"),
                         (F.row_number().over(everywhere.orderBy("source")) == 1).alias("first"))
    kept = materialise(terms.filter(F.col("all_docs") >= min_docs).drop("all_docs"), "terms")
    release(docs.sparkSession)
    return materialise(rows.select("lang", "source").distinct(), "groups"), kept


def corrections(rows: pd.DataFrame) -> pd.DataFrame:
    """(lang, source, item, value) of one slice of terms and one pair of blocks: what its terms add to V times the value without them.

    ``rows`` hold one row for each source with p of absent terms, term null, and one for each (source, term) with its p.
    """
    heads = rows[rows["term"].isna()].sort_values(["block", "source"])
    names, zero = heads["source"].to_numpy(), heads["p"].to_numpy(np.int64)
    sides = heads["block"].to_numpy()
    at = {(b, s): i for i, (b, s) in enumerate(zip(sides, names, strict=True))}
    body = rows[rows["term"].notna()]
    who = np.fromiter((at[k] for k in zip(body["block"], body["source"], strict=True)), np.int64, len(body))
    codes, _ = pd.factorize(body["term"])
    ps = body["p"].to_numpy(np.int64)
    order = np.lexsort((codes, who))
    who, codes, ps = who[order], codes[order], ps[order]
    edges = np.searchsorted(who, np.arange(len(names) + 1))
    own = [(codes[a:b], ps[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    low, high = rows["a"].iloc[0], rows["b"].iloc[0]
    dense = np.zeros(int(codes.max()) + 1 if len(codes) else 0, np.int64)
    out = []
    for j, (theirs, qs) in enumerate(own):
        dense[:] = zero[j]
        dense[theirs] = qs
        here = np.zeros(len(dense), bool)
        here[theirs] = True
        for i, (mine, p) in enumerate(own):
            if i == j or {sides[i], sides[j]} != {low, high} or not (len(mine) or len(theirs)):
                continue
            q = dense[mine]
            nothing = (zero[i] - zero[j]) ** 2 // zero[j]
            met = here[mine]
            value = int(((p - q) ** 2 // q - nothing).sum()) + int(((zero[i] - qs) ** 2 // qs - nothing).sum())
            both = q[met]
            value -= int(((zero[i] - both) ** 2 // both - nothing).sum())
            out.append((names[i], names[j], value))
    done = pd.DataFrame(out, columns=["source", "item", "value"])
    done.insert(0, "lang", rows["lang"].iloc[0])
    return done


def pair_rows(groups: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, item, value) of every ordered pair of a language's sources; groups carry p of absent terms, terms their p."""
    block = F.pmod(F.xxhash64("source"), F.col("blocks"))
    # a row meets the rows of every block of sources once, its own block included
    partner = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    heads = groups.filter("slices > 0").select(
        "lang", "source", F.lit(None).cast("string").alias("term"), F.col("p0").alias("p"), block.alias("block"), "blocks",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice"))
    body = kept.select("lang", "source", "term", "p", block.alias("block"), "blocks", F.pmod(F.xxhash64("term"), F.col("slices")).alias("slice"))
    both = heads.unionByName(body).select("lang", "source", "term", "p", "block", "slice", partner)
    both = both.withColumn("a", F.least("block", "other")).withColumn("b", F.greatest("block", "other"))
    part = both.groupBy("lang", "slice", "a", "b").applyInPandas(corrections, "lang string, source string, item string, value long")
    part = part.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    mine, theirs = groups.select("lang", "source", "p0", "v"), groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    pairs = mine.join(theirs, "lang").filter(F.col("source") != F.col("item"))
    even = F.when(F.col("v") > 0, F.col("v") * divergence(F.col("p0"), F.col("q0"))).otherwise(0)
    return pairs.select("lang", "source", "item", even.alias("even")).join(part, ["lang", "source", "item"], "left").select(
        "lang", "source", "item", (F.col("even") + F.coalesce("value", F.lit(0))).cast("long").alias("value"))


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", min_docs: int = MIN_DOCS, top: int = TOP_TERMS,
          slice_rows: int = SLICE_ROWS, block_sources: int = BLOCK_SOURCES) -> DataFrame:
    """(lang, source, part, item, value, rank): divergence of every group from each other source of its language, and its ``top`` telling terms.

    Part ``pair`` ranks the other sources by divergence, part ``term`` the terms more frequent in the group than in its language.
    """
    groups, kept = counted(docs, lang, source, text, min_docs)
    langs = kept.groupBy("lang").agg(F.count_if("first").alias("v"), F.sum("n").alias("lang_n"), F.count("*").alias("rows"))
    langs = groups.groupBy("lang").agg(F.count("*").alias("sources")).join(langs, "lang", "left")
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    zero = F.lit(0).cast("long")
    groups = groups.join(own, ["lang", "source"], "left").join(langs, "lang", "left").select(
        "lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("v", "group_n", "lang_n")],
        F.ceil(F.coalesce("rows", zero) / slice_rows).alias("slices"), F.ceil(F.col("sources") / block_sources).alias("blocks"))
    # stored, so that its size is known: terms meet it without a shuffle where it is small, by language and source where it is not
    groups = materialise(groups.withColumn("p0", F.when(F.col("v") > 0, smoothed(zero, F.col("group_n"), F.col("v")))), "groups")
    rated = kept.drop("first").join(groups.drop("p0"), ["lang", "source"]).select(
        "lang", "source", "term", "slices", "blocks", smoothed(F.col("n"), F.col("group_n"), F.col("v")).alias("p"),
        smoothed(F.col("all_n"), F.col("lang_n"), F.col("v")).alias("q"))
    pairs = pair_rows(groups, rated)
    telling = rated.filter(F.col("p") > F.col("q")).select("lang", "source", F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    shown = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return shown(ranked(pairs), "pair").unionByName(shown(ranked(telling).filter(F.col("rank") <= top), "term"))
