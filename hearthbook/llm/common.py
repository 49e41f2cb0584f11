"""Helpers shared by the operators of this package."""

from __future__ import annotations

import functools
import gc
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from hearthbook.functions.text import let  # noqa: F401
from hearthbook.session import materialise

# The contract's word: anything between spaces, tabs, line ends, vertical tabs and form feeds.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keeps_names(fn):
    """For ``fn(docs, ...) -> DataFrame`` that hands on the caller's columns: none of their names can meet one it works with.

    Columns that begin with an underscore, as all working names do, have others while ``fn`` runs; arguments that
    name them follow. Without such columns nothing changes.
    """
    @functools.wraps(fn)
    def run(docs: DataFrame, *args, **more) -> DataFrame:
        odd = {c: f"column{i}_of_caller" for i, c in enumerate(docs.columns) if c.startswith("_")}
        if not odd:
            return fn(docs, *args, **more)
        named = lambda v: odd.get(v, v) if isinstance(v, str) else v
        out = fn(docs.withColumnsRenamed(odd), *map(named, args), **{k: named(v) for k, v in more.items()})
        return out.withColumnsRenamed({new: old for old, new in odd.items()})
    return run


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def word_list(text: Column) -> Column:
    """Words of a text in order; an empty array for null or blank."""
    full = F.coalesce(text, F.lit(""))
    return F.filter(F.split(full, GAP + "+"), lambda w: w != "")


def running(df: DataFrame, order: list[Column], sums: dict[str, str], position: str) -> DataFrame:
    """Add the position (from 0) in a global order, and totals up to and with each row.

    Rows are dealt by range, counted per range and numbered inside it; only one row per range meets
    in one task, so the table may have any size.
    """
    df = materialise(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    heads = df.groupBy("_range").agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select("_range", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before")
                                     for c in ["_n", *[f"_{n}" for n in sums]]])
    inside = Window.partitionBy("_range").orderBy(*order)
    out = df.join(heads, "_range")
    out = out.withColumn(position, F.row_number().over(inside) - 1 + F.col("_n_before"))
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    for n, c in sums.items():
        out = out.withColumn(n, F.sum(c).over(upto) + F.col(f"_{n}_before"))
    return out.drop("_range", "_n_before", *[f"_{n}_before" for n in sums])


def release(spark: SparkSession, *stored: DataFrame) -> None:
    """Give back the disk of finished steps: their shuffle files, and stored tables that nothing reads any more."""
    for df in stored:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    # Spark drops shuffle files when the driver has collected what refers to them, by itself only every half hour
    gc.collect()
    spark._jvm.System.gc()


def slices(batch: pa.RecordBatch, sizes: pa.Array, most: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``most`` bytes by the ``sizes`` of rows, or of one row where that is larger."""
    upto = np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype(np.int64)) if batch.num_rows else np.empty(0, np.int64)
    low = 0
    while low < batch.num_rows:
        before = upto[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(upto, before + most, "right")))
        yield batch.slice(low, high - low)
        low = high


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected links: (node, component), component being the least node.

    Every round hands each node the least label among its neighbours and itself, then follows labels
    of labels; labels live in the shared folder and never visit the driver. Rounds grow with the
    logarithm of a chain, not with the size of a group.
    """
    both = links.select(F.col(a).alias("node"), F.col(b).alias("other"))
    both = materialise(both.union(both.select("other", "node")).filter("node != other").distinct(), "links")
    labels = materialise(both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("label")), "labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("other"), F.col("label").alias("theirs")), "other")
        best = seen.groupBy("node").agg(F.min("theirs").alias("theirs"))
        met = labels.join(best, "node").select("node", F.col("label").alias("was"), F.least("label", "theirs").alias("label"))
        # a label's own label is at most itself: one hop more per round
        met = materialise(met, "labels")
        roots = met.select(F.col("node").alias("label"), F.col("label").alias("root"))
        new = met.join(roots, "label", "left").select("node", "was", F.coalesce(F.least("label", "root"), "label").alias("label"))
        new = materialise(new, "labels")
        if new.filter("label != was").isEmpty():
            return new.select("node", F.col("label").alias("component"))
        labels = new.select("node", "label")


def digest(parts: Iterable[str]) -> str:
    return hashlib.sha256(",".join(parts).encode()).hexdigest()


def per_text(docs: DataFrame, fn, schema: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, *fn(text)) for every row, in Arrow batches; a null text is an empty one.

    Only the two columns are read; keys of any type and null keys pass through as they are.
    """
    kind = docs.schema[key].dataType.simpleString()
    out = T._parse_datatype_string(f"`{key}` {kind}, {schema}")
    arrow = to_arrow_schema(out)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [fn(x or "") for x in batch.column(1).to_pylist()]
            columns = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(list(arrow)[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(arrow.field(0).type), *columns], schema=arrow)

    return docs.select(docs[key].alias("k"), docs[text].alias("t")).mapInArrow(scan, out)


def hash_words(words: list[bytes]) -> np.ndarray:
    """A 64-bit value per word, alike in every process."""
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
