"""Repeated runs of lines, found over line ids by prefix doubling.

A text is the sequence of its \\n-split lines. A run of lines with ``min_words`` words or more that
also starts at an earlier place (smaller key, or same document and earlier line) is deleted there;
runs may overlap, and are judged on the input. A run holds enough words exactly if it is covered by
its shortest such runs, seen forwards from each first line and backwards from each last one, so only
those - at most two per line, of known length - have to be compared.

Comparing is prefix doubling: lines that equal another line get the place of the first such line as
their rank; from the ranks of runs of 2^t lines at i and i + 2^t follow those of 2^(t+1) lines at i.
Places whose rank is theirs alone leave, since no longer run there repeats. A run of n lines is known
by the ranks of its first and its last 2^t lines, 2^t <= n: the interval of the suffix array, with a
common prefix of n lines, that it belongs to. Overlapping deleted runs merge into the maximal ones.

Null texts have no lines. Rows repeated with key and text are one document: all keep the same lines.
Null keys come first. Keys used for different texts are taken in the order of the texts' hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from hearthbook.llm.common import keeps_names
from hearthbook.session import materialise

MIN_WORDS = 20


def shortest_runs(words: list[int], least: int) -> tuple[list[int], list[int]]:
    """For each line the length of the shortest run from it, and to it, with enough words; 0 where none is."""
    n = len(words)
    ahead, behind = [0] * n, [0] * n
    end, held = 0, 0
    for i in range(n):
        while end < n and held < least:
            held += words[end]
            end += 1
        if held < least:
            break
        ahead[i] = end - i
        held -= words[i]
    start, held = 0, 0
    for i in range(n):
        held += words[i]
        while start < i and held - words[start] >= least:
            held -= words[start]
            start += 1
        if held >= least:
            behind[i] = i - start + 1
    return ahead, behind


def line_rows(docs: DataFrame, key: str, text: str, least: int) -> DataFrame:
    """(doc, i, line, runs): every line's place, its 128-bit id and the lengths of the runs that start there."""
    kind = docs.schema[key].dataType.simpleString()
    schema = T._parse_datatype_string(f"k {kind}, h long, i int, a long, b long, runs array<int>")
    arrow = to_arrow_schema(schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where, marks, places, first, second, starts = [], [], [], [], [], []
            for row, (value, mark) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if value is None:
                    continue
                lines = value.encode("utf-8", "surrogatepass").split(b"\n")
                ahead, behind = shortest_runs([len(x.split()) for x in lines], least)
                begins = [[n] if n else [] for n in ahead]
                for i, n in enumerate(behind):
                    if n and ahead[i - n + 1] != n:
                        begins[i - n + 1].append(n)
                where += [row] * len(lines)
                marks += [mark] * len(lines)
                places += range(len(lines))
                for x in lines:
                    v = xxhash.xxh3_128_intdigest(x)
                    first.append(signed(v >> 64))
                    second.append(signed(v & MASK))
                starts += begins
            keys = batch.column(0).take(pa.array(where, pa.int64()))
            columns = [keys.cast(arrow.field(0).type), *[pa.array(x, f.type) for x, f in zip(
                [marks, places, first, second, starts], list(arrow)[1:], strict=True)]]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.xxhash64(text).alias("h")).mapInArrow(scan, schema)
    return rows.select(F.struct("k", "h").alias("doc"), "i", F.struct("a", "b").alias("line"), "runs")


MASK = (1 << 64) - 1


def signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def shared(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows whose ``by`` stands at more than one place, with the first of these places as rank."""
    place = F.struct("doc", "i")
    firsts = rows.groupBy(*by).agg(F.min(place).alias("rank"), F.max(place).alias("last"))
    return rows.join(firsts.filter("rank != last").drop("last"), by)


def repeated_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, i, n): runs of n lines from line i on that also start earlier; doc is (key, hash of the text)."""
    lines = shared(line_rows(docs, key, text, min_words), ["line"])
    lines = materialise(lines.select("doc", "i", "rank", "runs").dropDuplicates(["doc", "i"]), "lines")
    ranks = {0: lines.select("doc", "i", "rank")}
    runs = lines.select("doc", "i", F.explode("runs").alias("n"))
    longest = runs.agg(F.max("n")).first()[0] or 0
    level = 0
    while 2 ** (level + 1) <= longest:
        here, step = ranks[level], 2 ** level
        ahead = here.select("doc", (F.col("i") - step).alias("i"), F.col("rank").alias("then"))
        both = here.withColumnRenamed("rank", "now").join(ahead, ["doc", "i"])
        level += 1
        ranks[level] = materialise(shared(both, ["now", "then"]).select("doc", "i", "rank"), "ranks")
    found = None
    for t, rank in ranks.items():
        these = runs.filter((F.col("n") >= 2 ** t) & (F.col("n") < 2 ** (t + 1)))
        these = these.join(rank.withColumnRenamed("rank", "head"), ["doc", "i"])
        if t:
            tail = rank.select("doc", F.col("i").alias("j"), F.col("rank").alias("tail"))
            these = these.withColumn("j", F.col("i") + F.col("n") - 2 ** t).join(tail, ["doc", "j"]).drop("j")
        else:
            these = these.withColumn("tail", F.col("head"))
        again = shared(these, ["n", "head", "tail"]).filter(F.col("rank") != F.struct("doc", "i")).select("doc", "i", "n")
        found = again if found is None else found.unionAll(again)
    return found


KEPT = "n_lines long, n_removed long, n_runs long, kept string"


def cut(value: str | None, starts: list[int] | None, lengths: list[int] | None) -> tuple[int, int, int, str | None]:
    """Lines, deleted lines, maximal deleted runs and the text that is left."""
    if value is None:
        return 0, 0, 0, None
    lines = value.split("\n")
    gone, runs, upto, out, at = 0, 0, 0, [], 0
    for i, n in sorted(zip(starts or [], lengths or [], strict=True)):
        if i > upto or not runs:
            runs += 1
        new = max(i, upto)
        if i + n > new:
            out += lines[at:new]
            at = i + n
            gone += i + n - new
        upto = max(upto, i + n)
    out += lines[at:]
    return len(lines), gone, runs, "\n".join(out)


def drop_repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS,
                        marks: str = "_lines") -> DataFrame:
    """``docs`` with the repeated runs cut out of ``text``; other columns as they were.

    ``marks`` gets (n_lines, n_removed, n_runs), in place of a column that has this name.
    """
    return without_repeats(docs.drop(marks), key, text, min_words, marks)


@keeps_names
def without_repeats(docs: DataFrame, key: str, text: str, min_words: int, marks: str) -> DataFrame:
    gone = repeated_runs(docs, key, text, min_words).groupBy("doc").agg(
        F.sort_array(F.collect_list(F.struct("i", "n"))).alias("_gone"))
    named = docs.withColumn("_doc", F.struct(F.col(key).alias("k"), F.xxhash64(text).alias("h")))
    joined = named.join(gone.withColumnRenamed("doc", "_doc"), "_doc", "left")

    @F.pandas_udf(KEPT)
    def shorten(texts: pd.Series, starts: pd.Series, lengths: pd.Series) -> pd.DataFrame:
        rows = [cut(t, None if s is None else list(s), None if n is None else list(n))
                for t, s, n in zip(texts, starts, lengths, strict=True)]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in KEPT.split(", ")])

    out = joined.withColumn("_cut", shorten(F.col(text), F.col("_gone.i"), F.col("_gone.n")))
    cols = [F.col("_cut.kept").alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns]
    return out.select(*cols, F.struct("_cut.n_lines", "_cut.n_removed", "_cut.n_runs").alias(marks))
