"""Looking up the entries of a dictionary of any size in texts of any length.

A handful of keys is looked for one by one. Up to ``TRIE_KEYS`` short keys become one pattern that shares their
beginnings. Of more or longer ones, a key is looked up by an anchor, one of its pieces. A look-ahead pattern slides over the text once and
gives its pieces; only where an anchor stands is its key compared, beside the text, in the same task.
Texts are cut into stretches that overlap by the longest key, so no comparison reads more than one
stretch and the cost grows with the length of the text, not with its square.

Anchors are the pieces least frequent in the texts, counted on the first ``SAMPLE`` stretches; that
choice changes the cost and never the result. A key whose rarest short piece still stands in many
stretches is anchored by a longer one. Dictionaries of up to ``BROADCAST_KEYS`` keys are broadcast,
after counting them; larger ones meet the pieces in a shuffle, and their hits meet the texts in another.

Keys that are null or empty match nothing. Texts that are null hold no key. Repeated rows give a pair once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from hearthbook.functions.prefilter import occurring
from hearthbook.functions.text import let
from hearthbook.operators.ordering import cap_per_group
from hearthbook.session import materialise

ANCHOR, LONG_ANCHOR = 4, 8
STRETCH = 4096
SAMPLE = 1000
HOT = 0.02
BROADCAST_KEYS, BROADCAST_CHARS = 200_000, 8_000_000
TRIE_KEYS, TRIE_CHARS, TRIE_LONGEST = 20_000, 200_000, 64
FEW_KEYS = 16


def stretches(docs: DataFrame, id_col: str, text: Column, longest: int) -> DataFrame:
    """(id, part): the text in stretches, each reaching ``longest - 1`` letters into the next."""
    step = max(STRETCH, longest)
    cut = F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{1,{step + longest - 1}}})).{{1,{step}}}"), F.lit(1))
    return docs.select(F.col(id_col).alias("id"), F.explode(cut).alias("part"))


def pieces(text: Column, sizes: list[int]) -> Column:
    """Distinct pieces of these numbers of letters, from one pass per size."""
    found = [F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in sizes]
    return F.array_distinct(found[0] if len(found) == 1 else F.concat(*found))


def anchored(keys: DataFrame, parts: DataFrame) -> DataFrame:
    """(key, anchor): the piece of each key that the first stretches hold least often."""
    spark = keys.sparkSession
    # at most SAMPLE * STRETCH letters come to the driver, however long the longest key
    seen = [(r[0],) for r in parts.select(F.substring("part", 1, STRETCH)).limit(SAMPLE).collect()]
    sample = spark.createDataFrame(seen, T.StructType([T.StructField("part", T.StringType())]))
    often = HOT * max(len(seen), 1)

    def rarest(some: DataFrame, size: int) -> DataFrame:
        counted = sample.select(F.explode(pieces(F.col("part"), [size])).alias("anchor")).groupBy("anchor").agg(F.count("*").alias("n"))
        own = some.select("key", F.explode(pieces(F.col("key"), [size])).alias("anchor"))
        best = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "anchor")).alias("a")
        return own.join(counted, "anchor", "left").groupBy("key").agg(best).select("key", "a.anchor", "a.n")

    whole = keys.filter(F.length("key") <= ANCHOR).select("key", F.col("key").alias("anchor"))
    short = materialise(rarest(keys.filter(F.length("key") > ANCHOR), ANCHOR), "anchors")
    extend = (F.col("n") > often) & (F.length("key") >= LONG_ANCHOR)
    long = rarest(short.filter(extend).select("key"), LONG_ANCHOR)
    return whole.unionByName(short.filter(~extend).select("key", "anchor")).unionByName(long.select("key", "anchor"))


def few_keys(docs: DataFrame, id_col: str, text: Column, keys: list[str]) -> DataFrame:
    """(id, key) of a handful of keys, looked for one by one."""
    known = F.array(*[F.lit(k) for k in keys]).cast("array<string>")
    found = let(text, lambda t: F.filter(known, lambda k: F.contains(t, k)))
    return docs.select(F.col(id_col).alias("id"), F.explode(found).alias("key")).distinct()


def by_letters(docs: DataFrame, id_col: str, text: Column, keys: list[str]) -> DataFrame:
    """(id, key) from one pass that reads the keys letter by letter: only keys found leave the text."""
    there = set(keys)
    # the pass gives the longest key of a place; shorter ones that it begins with stand there as well
    begins = [(k, k[:n]) for k in keys for n in range(1, len(k) + 1) if k[:n] in there]
    hits = docs.select(F.col(id_col).alias("id"), F.explode(occurring(text, keys)).alias("found"))
    return hits.join(F.broadcast(docs.sparkSession.createDataFrame(begins, "found string, key string")), "found").select("id", "key").distinct()


def contained(docs: DataFrame, id_col: str, text: Column, keys: DataFrame, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """(id, key) for every key found anywhere in a text of that id, each pair once. ``keys`` has the column key."""
    keys = materialise(keys.filter(F.length("key") > 0).select("key").distinct(), "keys")
    many, longest, letters = keys.agg(F.count("*"), F.max(F.length("key")), F.sum(F.length("key"))).first()
    if many <= min(FEW_KEYS, broadcast_keys) and (letters or 0) <= STRETCH:
        return few_keys(docs, id_col, text, [r[0] for r in keys.collect()])
    if many <= min(TRIE_KEYS, broadcast_keys) and letters <= TRIE_CHARS and longest <= TRIE_LONGEST:
        return by_letters(docs, id_col, text, [r[0] for r in keys.collect()])
    parts = stretches(docs, id_col, text, longest or 1)
    anchors = materialise(anchored(keys, parts), "anchors")
    sizes = sorted(r[0] for r in anchors.select(F.length("anchor")).distinct().collect()) or [ANCHOR]
    if many <= broadcast_keys and (letters or 0) <= BROADCAST_CHARS:
        there = parts.select("id", "part", F.explode(pieces(F.col("part"), sizes)).alias("anchor"))
        hits = there.join(F.broadcast(anchors), (there["anchor"] == anchors["anchor"]) & F.contains(there["part"], anchors["key"]))
        return hits.select("id", "key").distinct()
    numbered = materialise(parts.withColumn("at", F.monotonically_increasing_id()), "stretches")
    there = numbered.select("at", F.explode(pieces(F.col("part"), sizes)).alias("anchor"))
    close = there.join(anchors, "anchor").select("at", "key")
    return close.join(numbered, "at").filter(F.contains("part", F.col("key"))).select("id", "key").distinct()


def match_dictionary(
    docs: DataFrame, id_col: str, text: Column, dictionary: DataFrame, key: str = "key", min_len: int = 4,
    max_chars: int | None = None,
) -> DataFrame:
    """(id, key) for every dictionary key of ``min_len`` letters or more that occurs in the lower-cased text."""
    whole = F.lower(text if max_chars is None else F.substring(text, 1, max_chars))
    keys = dictionary.select(F.lower(F.col(key)).alias("key")).filter(F.length("key") >= min_len)
    return contained(docs, id_col, whole, keys).withColumnRenamed("id", id_col)


def best_dictionary_match(found: DataFrame, id_col: str, dictionary: DataFrame, key: str = "key",
                          priority: str | None = None) -> DataFrame:
    """One entry per text: by priority, then the longest key, then the name."""
    entries = dictionary.withColumn("key", F.lower(F.col(key)))
    order = ([F.asc(priority)] if priority else []) + [F.desc(F.length("key")), F.asc("key")]
    return cap_per_group(found.join(entries, "key"), [id_col], order, 1)


def mentions(texts: DataFrame, id_col: str, text: Column, people: DataFrame, name: str = "name", min_len: int = 1) -> DataFrame:
    """(id, name) for each known person of ``min_len`` letters or more named in a text, case included."""
    keys = people.select(F.col(name).alias("key")).filter(F.length("key") >= min_len)
    return contained(texts, id_col, text, keys).select(F.col("id").alias(id_col), F.col("key").alias(name))


def match_dictionaries(
    rows: DataFrame, id_col: str, fields: dict[str, Column], lookups: dict[str, tuple[str, DataFrame, int]],
) -> DataFrame:
    """(id, one column per lookup): the display name of the best entry of several dictionaries in several fields, in one pass.

    ``lookups`` maps an output column to (field, dictionary with key and display, least length). The longest
    key wins, then the first by name. Rows without any match are absent.
    """
    tagged = None
    for out, (field, dictionary, least) in lookups.items():
        entries = dictionary.select(F.lit(out).alias("lookup"), F.lit(field).alias("field"), F.lower("key").alias("key"), "display").filter(F.length("key") >= least)
        tagged = entries if tagged is None else tagged.unionByName(entries)
    tagged = materialise(tagged, "entries")
    structs = [F.struct(F.col(id_col).alias("row"), F.lit(f).alias("field"), F.lower(c).alias("text")) for f, c in fields.items()]
    lines = rows.select(F.inline(F.array(*structs)))
    lines = lines.select(F.struct("row", "field").alias("line"), "text").filter(F.length("text") > 0)
    found = contained(lines, "line", F.col("text"), tagged.select("key"))
    found = found.select(F.col("id.row").alias(id_col), F.col("id.field").alias("field"), "key").join(tagged, ["field", "key"])
    rank = F.struct(-F.length("key"), F.col("key"), F.col("display").alias("display"))
    best = [F.min(F.when(F.col("lookup") == out, rank))["display"].alias(out) for out in lookups]
    return found.groupBy(id_col).agg(*best)
