"""Queries over whole corpora: conversation trie, source audit, language-model scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hearthbook.llm import conversation_trie, lm_scoring, source_audit
from hearthbook.llm.common import table
from hearthbook.llm.queries import query
from hearthbook.session import materialise

# CRC-32 of the decimal digits of c, by the usual table (tab) of the reflected polynomial 0xEDB88320.
DUCK_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
  lambda a, b: xor(a >> 8, tab[xor(a, b) % 256 + 1])))"""

TRIE_SQL = rf"""
WITH RECURSIVE bits AS (
  SELECT i, i::BIGINT AS v, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS tab FROM bits WHERE k = 8),
o AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS t,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS p
      FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT c FROM o),
plan AS (SELECT c, ({DUCK_CRC32} % 4)::BIGINT AS h, c - c % 20 AS base FROM ids, crc),
front AS (SELECT plan.c, o.p, o.r, o.t FROM plan JOIN o ON o.c = plan.base AND o.p < plan.h),
m AS (SELECT plan.c, h, count(front.c) AS m FROM plan LEFT JOIN front ON front.c = plan.c GROUP BY plan.c, h),
rebuilt AS (SELECT c, p, r, t FROM front UNION ALL SELECT o.c, o.p - h + m, r, t FROM o JOIN m USING (c) WHERE p >= h),
seq AS (SELECT m.c, coalesce(list(struct_pack(r := r, t := t) ORDER BY p) FILTER (p IS NOT NULL), []) AS s
        FROM m LEFT JOIN rebuilt ON rebuilt.c = m.c GROUP BY m.c),
pre AS (SELECT c, len(s) AS n, d, s[1:d] AS path, s FROM seq, range(0, 100000) r(d) WHERE d <= len(s)),
named AS (SELECT d AS depth, path, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '') AS ends
          FROM pre GROUP BY d, path),
kids AS (SELECT depth - 1 AS depth, path[1:depth - 1] AS path, count(*) AS k FROM named WHERE depth > 0 GROUP BY ALL),
full_ AS (SELECT named.*, coalesce(k, 0) AS n_children,
                 CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(path[depth].t, '[^\x20\x09-\x0D]+')) END AS own
          FROM named LEFT JOIN kids USING (depth, path)),
up AS (SELECT a.depth AS depth, a.path[1:a.depth] AS path, u.own, u.n_children = 0 AS leaf
       FROM (SELECT d AS depth, path[1:d] AS path, x.path AS low, x.depth AS low_depth
             FROM full_ x, range(0, 100000) r(d) WHERE d <= x.depth) a
       JOIN full_ u ON u.depth = a.low_depth AND u.path = a.low),
sums AS (SELECT depth, path, sum(own) AS saved, count(*) FILTER (leaf) AS leaves FROM up GROUP BY depth, path)
SELECT f.conv_id::BIGINT AS conv_id, f.depth::BIGINT AS depth, a.conv_id::BIGINT AS parent_conv_id, f.n_convs::BIGINT AS n_convs,
       f.n_children::BIGINT AS n_children, sums.leaves::BIGINT AS n_leaves, sums.saved::BIGINT AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM full_ f JOIN sums USING (depth, path) LEFT JOIN named a ON a.depth = f.depth - 1 AND a.path = f.path[1:f.depth - 1]"""


def grafted(turns: DataFrame, block: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv, n) and turns, each begun with the first h turns of the first conversation of its block.

    h is the CRC-32 of the decimal key modulo ``most``; the conversation's own turns follow after its first h.
    """
    sizes = turns.groupBy("conv").agg((F.max("pos") + 1).alias("own"))
    heads = turns.filter((F.col("conv") % block == 0) & (F.col("pos") < most - 1)).groupBy(F.col("conv").alias("base")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "digest", "words"))).alias("head"))
    plan = sizes.select("conv", "own", (F.crc32(F.col("conv").cast("string")) % most).cast("int").alias("h"), (F.col("conv") - F.col("conv") % block).alias("base"))
    plan = plan.join(heads, "base", "left")
    front = F.when(F.col("head").isNull() | (F.col("h") == 0), F.array()).otherwise(F.slice("head", 1, F.greatest("h", F.lit(1))))
    plan = materialise(plan.select("conv", "own", "h", front.alias("front")).withColumn("m", F.size("front").cast("long")), "grafts")
    kept = turns.join(plan.select("conv", "h", "m"), "conv").filter(F.col("pos") >= F.col("h"))
    rebuilt = plan.select("conv", F.inline("front")).unionByName(kept.select("conv", (F.col("pos") - F.col("h") + F.col("m")).alias("pos"), "digest", "words"))
    return plan.select("conv", (F.col("m") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n")), rebuilt


@query("op12_conversation_trie", TRIE_SQL)
def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of the rebuilt conversations."""
    turns = materialise(conversation_trie.ordered_turns(table(spark, sf_dir, "conversations")), "turns")
    convs, rebuilt = grafted(turns)
    return conversation_trie.prefix_trie(convs, materialise(rebuilt, "turns"))


AUDIT_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                         '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS all_n FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
l AS (SELECT lang, count(*) AS v, sum(all_n) AS lang_n FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT lang, source, coalesce(sum(n), 0) AS group_n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(n, 0) + 1) // (group_n + v)::HUGEINT AS p,
             1 + 1000000000::HUGEINT * (all_n + 1) // (lang_n + v)::HUGEINT AS q
      FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, 'pair' AS part, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
      UNION ALL SELECT *, 'term', row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= 200"""


@query("op13_source_audit", AUDIT_SQL)
def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of every source from the others of its language, and the terms that tell it from the language."""
    return source_audit.audit(table(spark, sf_dir, "documents"))


@query("op11_lm_scoring")
def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothed frequency and network log10 probability of every document, one in ten held out of learning."""
    return lm_scoring.lm_scores(table(spark, sf_dir, "documents").select("doc_id", "text"))
