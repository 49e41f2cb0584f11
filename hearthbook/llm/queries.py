"""The registered queries of this package and their SQL twins."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from hearthbook.llm import licences, line_dedup, mixing, near_dedup, pieces, pii, quality, secrets, suffix_dedup, topk
from hearthbook.llm.common import table
from hearthbook.session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Words of a text in DuckDB, as in common.WORD.
DUCK_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def query(name: str, sql: str | None = None):
    def wrap(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run
    return wrap


QUALITY_SQL = rf"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS x, {DUCK_WORDS} AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, w FROM t),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM s),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g),
spread AS (SELECT DISTINCT doc_id, i + k AS p FROM twice, (SELECT unnest(range(5)) AS k) WHERE n > 1),
rep AS (SELECT doc_id, count(*) AS n FROM spread GROUP BY doc_id),
f AS (
  SELECT t.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         len(regexp_extract_all(x, '[#*$%&|<>]')) AS n_symbols, len(regexp_extract_all(x, '\p{{Lu}}')) AS n_upper,
         len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM t LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR 2 * n_upper > word_chars OR word_chars < 2 * n_words
            OR word_chars > 15 * n_words OR 10 * n_dup_lines > 3 * n_lines) AS kept
FROM b"""


@query("op2_quality_rules", QUALITY_SQL)
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality features, the contract's base verdict and the cascade's verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = [rule for rule, _, _ in quality.order_rules(docs)]
    f = lambda name: F.col(f"_q_{name}")
    base = (f("n_words") < 10) | (100 * f("n_repeat_words") > 20 * f("n_words"))
    shown = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return quality.measured(docs).select("doc_id", *[f(c).alias(c) for c in shown], base.alias("base_failed"),
                                         quality.cascade(f, rules).alias("kept"))


@query("op8_secret_scans")
def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets and linked credential parts of every document."""
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


@query("op3_private_data")
def op3_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document, with the terms that disclose it."""
    return pii.sanitise(table(spark, sf_dir, "documents"))


LINES_SQL = r"""
WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
e AS (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS x FROM t),
c AS (SELECT doc_id, i, x, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS w,
             sum(len(regexp_extract_all(x, '[^\x20\x09-\x0D]+'))) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM e),
runs AS (
  SELECT a.doc_id, a.i AS a, b.i AS b FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.i >= a.i
  WHERE b.upto - a.upto + a.w >= 20 AND (b.upto - b.w - a.upto + a.w < 20 OR b.upto - a.upto < 20)),
same AS (SELECT r.doc_id, a, b, row_number() OVER (
           PARTITION BY b - a, array_to_string(l[a:b], chr(10)) ORDER BY r.doc_id, a) AS nth
         FROM runs r JOIN t USING (doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS i FROM same WHERE nth > 1),
g AS (SELECT c.doc_id, c.i, c.x, gone.i IS NOT NULL AS gone FROM c LEFT JOIN gone USING (doc_id, i)),
h AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM g),
s AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_runs,
             sha256(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
      FROM h GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(n_runs, 0)::BIGINT AS n_runs, kept_sha256
FROM documents d LEFT JOIN s USING (doc_id)"""


@query("op10_line_dedup", LINES_SQL)
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deleted lines of every document, and the digest of what is left."""
    out = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "_lines.*", F.sha2("text", 256).alias("kept_sha256"))


@query("op9_minhash_near_dedup")
def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near copies of every document, named by its least doc_id."""
    out = near_dedup.near_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("class").alias("class_id"))


@query("op1_source_mixing")
def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of all sources to target weights takes of every document."""
    out = mixing.mix(table(spark, sf_dir, "documents"))
    rows = F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))
    return out.select("doc_id", "size", "source_size", "target", "taken", rows.alias("_")).drop("_")


@query("op6_sentencepiece")
def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and digest of every document's ids, and whether decoding gives the text back."""
    coded = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), round_trip="round_trip")
    listed = F.array_join(F.transform("ids", lambda i: i.cast("string")), ",")
    return coded.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"),
                        F.sha2(listed, 256).alias("ids_sha256"), "round_trip")


@query("op7_license_scans")
def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices of every document by family."""
    return licences.scan_licences(table(spark, sf_dir, "documents").select("doc_id", "text"))


TOPK_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""


@query("op5_exact_top_k", TOPK_SQL)
def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best inner products of every hundredth vector with all others."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(rows, rows.filter(F.col("vec_id") % 100 == 0))


@query("op4_suffix_array_dedup")
def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the 100-byte strings that start earlier."""
    out = suffix_dedup.drop_repeated_bytes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
