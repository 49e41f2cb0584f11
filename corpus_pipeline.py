"""From raw documents to encoded training text: five stages, each written and read again."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, functions as F

from hearthbook.llm import line_dedup, mixing, near_dedup, pieces, quality
from hearthbook.llm.common import WORD
from hearthbook.session import materialise, ship


def stage(fn):
    """A stage whose tasks find the package on every executor."""
    @functools.wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return fn(spark, docs, sf_dir)
    return run_stage


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    return quality.quality_filter(docs)


@stage
def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines are cut out, and documents of which nothing is left; n_chars follows the text."""
    out = line_dedup.drop_repeated_lines(docs.drop("n_chars"))
    out = out.filter(F.coalesce(F.col("text").rlike(WORD), F.lit(False)) | (F.col("_lines.n_removed") == 0))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


@stage
def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return near_dedup.drop_near_copies(docs)


@stage
def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: rows as often as they are taken, in shards, shuffled within each."""
    return mixing.mixed_rows(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


@stage
def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and whether they decode to it."""
    coded = pieces.encode(docs, round_trip="round_trip")
    return coded.select("doc_id", "lang", "source", "ids", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), "round_trip")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("minhash_near_dedup", near_dedup_stage),
    ("source_mixing", source_mixing),
    ("sentencepiece", sentencepiece),
]

# The mix draws by a hash and the encoder merges pieces: neither has a form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = materialise(docs, name)
    return docs
