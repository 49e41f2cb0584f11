"""Personal data, and the terms that give it away.

Addresses, numbers and cards are found by pattern. What stands in the same document can name the same
person: over the whole corpus, the information that a term t carries about a protected value c is
PMI(c; t) = log(N n(c,t) / (n(c) n(t))), and c itself holds IC(c) = log(N / n(c)). All four count
documents, copies included. A term with PMI >= IC / alpha that meets c in ``support`` different texts
or more discloses c in every document that holds c, wherever it stands: it is removed if PMI >= IC,
else generalised to the shape of its letters. A page copied a thousand times is one text: whatever
stands only there is no evidence.

Null texts are empty; repeated rows give repeated results; columns beside key and text are not read.
"""

from __future__ import annotations

import bisect
import re

import xxhash
from pyspark.sql import DataFrame, functions as F

from hearthbook.llm.common import digest, per_text
from hearthbook.llm.spans import private_spans
from hearthbook.session import materialise

KINDS = ("email", "ip", "card", "phone")
NEAR = re.compile(r"[^\W\d_]+")


def free_words(text: str, spans: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """All terms of a text with their places, those outside of every span."""
    merged = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    starts = [a for a, _ in merged]

    def free(a: int, b: int) -> bool:
        i = bisect.bisect_left(starts, b)
        return i == 0 or merged[i - 1][1] <= a

    return [(m.group().lower(), *m.span()) for m in NEAR.finditer(text) if free(*m.span())]


FOUND = ("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, same binary, "
         "entities array<string>, words array<struct<term:string,at:int,to:int>>")


def find(text: str) -> tuple:
    """Counts and spans of a text; its hash, entities and terms if it has spans."""
    kinds = private_spans(text)
    spans = [(k, a, b) for k in KINDS for a, b in kinds[k]]
    base = [f"{k}:{a}:{b}" for k, a, b in spans]
    same, entities, words = None, [], []
    if spans:
        same = xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))
        entities = sorted({f"{k}:{text[a:b].lower()}" for k, a, b in spans})
        words = [{"term": w, "at": x, "to": y} for w, x, y in free_words(text, [(a, b) for _, a, b in spans])]
    return (*[len(kinds[k]) for k in KINDS], digest(base), ",".join(base), same, entities, words)


def sanitise(docs: DataFrame, key: str = "doc_id", text: str = "text", alpha: float = 1.5, support: int = 3) -> DataFrame:
    """One row per document: counts, the digest of the found spans, and all spans with disclosing terms.

    Spans read ``kind:start:end`` in code points, end exclusive, by kind - email, ip, card, phone,
    generalised, removed - then start.
    """
    found = per_text(docs, find, FOUND, key, text)
    found = materialise(found.withColumn("row", F.monotonically_increasing_id()), "found")
    held = found.filter("same is not null").select("row", "same", "entities", "words")
    terms = materialise(disclosing(docs, held, text, alpha, support), "terms")
    near = held.withColumn("entity", F.explode("entities")).join(terms.select("entity").distinct(), "entity", "left_semi")
    near = near.select("row", "entity", F.explode("words").alias("w")).select("row", "entity", "w.*")
    spans = near.join(terms, ["entity", "term"]).groupBy("row", "at", "to").agg(F.max("removed").alias("removed"))
    spans = spans.groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("removed", "at", "to"))).alias("s"), F.count("*").alias("n_terms"))
    shown = F.transform("s", lambda x: F.concat_ws(
        ":", F.when(x["removed"], "removed").otherwise("generalised"), x["at"].cast("string"), x["to"].cast("string")))
    out = found.join(spans.select("row", "n_terms", F.array_join(shown, ",").alias("more")), "row", "left")
    both = F.filter(F.array("base", "more"), lambda x: x.isNotNull() & (x != ""))
    return out.select(key, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", F.array_join(both, ",").alias("spans"),
                      F.coalesce("n_terms", F.lit(0)).cast("long").alias("n_terms"))


def disclosing(docs: DataFrame, held: DataFrame, text: str, alpha: float, support: int) -> DataFrame:
    """(entity, term, removed) for the terms that disclose an entity; all counts cover the whole corpus."""
    texts = held.groupBy("same").agg(F.count("*").alias("copies"), F.min("row").alias("row"))
    texts = held.drop("same").join(texts.select("row", "copies"), "row")
    each = texts.select("row", "copies", F.explode("entities").alias("entity"))
    # no term meets an entity in more texts than hold the entity
    entities = each.groupBy("entity").agg(F.count("*").alias("n_texts"), F.sum("copies").alias("n_entity"))
    entities = materialise(entities.filter(F.col("n_texts") >= support).drop("n_texts"), "entities")
    each = each.join(entities.select("entity"), "entity").join(texts.select("row", "words"), "row")
    each = each.select("entity", "copies", F.explode(F.array_distinct("words.term")).alias("term"))
    joint = each.groupBy("entity", "term").agg(F.count("*").alias("n_texts"), F.sum("copies").alias("n_both"))
    pairs = materialise(joint.filter(F.col("n_texts") >= support).join(entities, "entity"), "pairs")
    words = F.array_distinct(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}]+"))
    # counted before they are joined: a term makes one row, however many documents hold it
    seen = docs.select(F.explode(words).alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
    total = docs.agg(F.count("*").alias("n"))
    known = pairs.join(seen, "term").join(F.broadcast(total))  # one row
    pmi = F.log(F.col("n") * F.col("n_both") / (F.col("n_entity") * F.col("n_term")))
    ic = F.log(F.col("n") / F.col("n_entity"))
    return known.filter((ic > 0) & (pmi >= ic / alpha)).select("entity", "term", (pmi >= ic).alias("removed"))


def masked(text: str, spans: str) -> str:
    """``text`` with found spans named by kind, generalised terms as their shape and removed ones gone."""
    parts = [(int(a), int(b), k) for k, a, b in (s.split(":") for s in spans.split(",") if s)]
    out, done = [], 0
    for a, b, kind in sorted(parts):
        if a < done:
            continue
        out.append(text[done:a])
        if kind == "generalised":
            out.append("".join("X" if c.isupper() else "x" for c in text[a:b]))
        elif kind != "removed":
            out.append(f"[{kind}]")
        done = b
    return "".join(out) + text[done:]
