"""The elements of huge JSON arrays, read by many tasks.

One JSON array in one file has no line ends to split at. Here a file is read in blocks at closing
brackets, wherever they stand. Whether a block begins inside a string follows from the number of
quotes in all blocks before it, and its depth from their brackets: two running sums over one small row
per block. Knowing both, each block cuts out the elements that begin in it; what the block before left
open is put together by element, so a task holds a block's records and one element, never a file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from hearthbook.session import materialise

END = "}"
MARKS = re.compile(r'\\.|["\[\]{},]', re.DOTALL)


class Scanner:
    """Depth and strings along a text, and the pieces of the elements one bracket deep."""

    def __init__(self, quoted: bool, depth: int):
        self.quoted, self.depth, self.number, self.open = quoted, depth, -1, []

    def read(self, text: str) -> list[tuple[int, str]]:
        """(number, text) of the elements that end in the text; -1 numbers the one that was open before the block."""
        done, start = [], 0
        for m in MARKS.finditer(text):
            mark = m[0]
            if mark == '"':
                self.quoted = not self.quoted
            elif self.quoted or len(mark) > 1:
                continue
            elif self.depth == 1 and mark in ",]}":
                # an element ends before a comma, or before the bracket that closes the array
                self.open.append(text[start:m.start()])
                done.append((self.number, "".join(self.open)))
                self.open, start = [], m.end()
                self.number += mark == ","
                self.depth -= mark != ","
            elif mark in "[{":
                self.depth += 1
                if self.depth == 1:
                    self.number, self.open, start = self.number + 1, [], m.end()
            elif mark in "]}":
                self.depth -= 1
        if self.depth > 0:
            self.open.append(text[start:])
        return done


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("lineSep", END).text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, str, bool]]:
    """(key, text, first of its block) of every record in the order of the file."""
    at = None
    for b in batches:
        for *key, text in zip(*[c.to_pylist() for c in b.columns], strict=True):
            yield tuple(key), text + END, tuple(key) != at
            at = tuple(key)


def change(text: str, quoted: bool) -> tuple[bool, int]:
    """Whether a string is open behind the text, and by how much it goes deeper."""
    deeper = 0
    for m in MARKS.finditer(text):
        if m[0] == '"':
            quoted = not quoted
        elif not quoted and m[0] in "[]{}":
            deeper += 1 if m[0] in "[{" else -1
    return quoted, deeper


def json_elements(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, number, value): the text of every element of the arrays in ``path``; file, block and number give their order.

    Empty arrays and files have none. A file that is no array gives nothing to rely on.
    """
    key = "file string, block long"
    sums = T._parse_datatype_string(f"{key}, quotes long, outside long, inside long")
    sums_arrow = to_arrow_schema(sums)

    def measure(batches):
        done: dict[tuple, list] = {}
        for k, text, fresh in _by_block(batches):
            # what the block does if it begins outside a string, and inside one
            both = done.setdefault(k, [False, 0, True, 0])
            for i in (0, 2):
                both[i], deeper = change(text, both[i])
                both[i + 1] += deeper
        rows = [(*k, int(v[0]), v[1], v[3]) for k, v in done.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(sums_arrow)], schema=sums_arrow)

    blocks = _blocks(spark, path)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = materialise(blocks.mapInArrow(measure, sums), "blocks")
    started = sizes.withColumn("quoted", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1)
    started = started.withColumn("change", F.when(F.col("quoted"), F.col("inside")).otherwise(F.col("outside")))
    started = materialise(started.select("file", "block", "quoted", F.coalesce(F.sum("change").over(before), F.lit(0)).alias("depth")), "blocks")

    cut = T._parse_datatype_string(f"{key}, number long, value string, ends boolean")
    cut_arrow = to_arrow_schema(cut)
    # one row of four values per block of the files: a join that leaves the records where and as they are
    placed = blocks.join(F.broadcast(started), ["file", "block"]).select("file", "block", "quoted", "depth", "value")

    def split(batches):
        out, scan, at = [], None, None

        def close():
            if scan is not None and scan.open:
                out.append((*at, scan.number, "".join(scan.open), False))

        def drained():
            batch = pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], f.type) for i, f in enumerate(cut_arrow)], schema=cut_arrow)
            out.clear()
            return batch

        for k, text, fresh in _by_block(batches):
            if fresh:
                close()
                scan, at = Scanner(*k[2:]), k[:2]
            out.extend((*at, number, value, True) for number, value in scan.read(text))
            if len(out) >= 1000:
                yield drained()
        close()
        yield drained()

    pieces = materialise(placed.mapInArrow(split, cut), "pieces")
    # number -1 is what an earlier block left open: its element is the last that began before
    opened = pieces.filter("number >= 0 AND NOT ends").select("file", "block", F.struct("block", "number").alias("began"))
    per_block = started.select("file", "block").join(opened, ["file", "block"], "left")
    carried = per_block.select("file", "block", F.last("began", ignorenulls=True).over(before).alias("began"))
    led = pieces.filter("number < 0").join(carried, ["file", "block"])
    own = F.struct("block", "number")
    spread = pieces.filter("number >= 0 AND NOT ends").select("file", "block", own.alias("began"), "value").unionByName(led.select("file", "block", "began", "value"))
    joined = spread.groupBy("file", "began").agg(F.array_sort(F.collect_list(F.struct("block", "value"))).alias("parts"))
    joined = joined.select("file", "began.block", "began.number", F.array_join(F.transform("parts", lambda p: p["value"]), "").alias("value"))
    whole = pieces.filter("number >= 0 AND ends").select("file", "block", "number", "value")
    return whole.unionByName(joined).filter(F.regexp_like("value", F.lit(r"\S")))
